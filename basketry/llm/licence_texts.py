"""Known licence texts and one-line notices; fixed values."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

TEXTS = {
    "MIT": MIT,
    "MIT (titled)": f"MIT License\n\n{MIT}",
    "MIT (the title)": f"The MIT License (MIT)\n\n{MIT}",
    "ISC": ISC,
    "ISC (titled)": f"ISC License\n\n{ISC}",
    "BSD-2-Clause": BSD_CONDITIONS + BSD_DISCLAIMER,
    "BSD-2-Clause (titled)": f"BSD 2-Clause License\n\n{BSD_CONDITIONS}{BSD_DISCLAIMER}",
    "BSD-3-Clause": BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER,
    "BSD-3-Clause (titled)": f"BSD 3-Clause License\n\n{BSD_CONDITIONS}{BSD_NAMES}{BSD_DISCLAIMER}",
    "Zlib": ZLIB,
    "Zlib (titled)": f"zlib License\n\n{ZLIB}",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "MIT (notice)": "Released under the MIT License.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (spdx)": "SPDX-License-Identifier: Apache-2.0",
    "BSD-3-Clause (spdx)": "SPDX-License-Identifier: BSD-3-Clause",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (spdx)": "SPDX-License-Identifier: GPL-3.0-only",
    "MIT": "Released under the MIT License.",
    "MIT (licensed)": "Licensed under the MIT License.",
    "MIT (spdx)": "SPDX-License-Identifier: MIT",
}

#: SHA-256 of the canonical forms of long licences; "(terms)" stands for the text without the appendix on its use; fixed values.
DIGESTS = {
    "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184": "Apache-2.0",
    "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0": "Apache-2.0 (terms)",
    "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a": "Apache-2.0 (terms)",
    "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2": "Apache-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e": "GFDL-1.2",
    "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff": "GFDL-1.3",
    "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f": "GPL-1.0",
    "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9": "GPL-1.0 (terms)",
    "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0": "GPL-1.0 (terms)",
    "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6": "GPL-2.0",
    "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0": "GPL-2.0 (terms)",
    "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef": "GPL-2.0 (terms)",
    "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8": "GPL-3.0",
    "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b": "GPL-3.0 (terms)",
    "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153": "GPL-3.0 (terms)",
    "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e": "LGPL-2.0",
    "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389": "LGPL-2.0 (terms)",
    "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c": "LGPL-2.0 (terms)",
    "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692": "LGPL-2.1",
    "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97": "LGPL-2.1 (terms)",
    "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30": "LGPL-2.1 (terms)",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
    "f507d73d343a3d7b0b7ecd39319f6c349b515eeed80b814918af61cdac69e4a5": "Unlicense",
    "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229": "Unlicense",
}
