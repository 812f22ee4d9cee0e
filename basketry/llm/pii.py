"""Personal data replaced by format-preserving pseudonyms, in Spark expressions alone.

Numbers and dates that pass their checks are permuted within their own format by a keyed Feistel
network over two parts, with additions modulo the sizes of the parts: a card number becomes another
of as many digits whose check digit is right, a long number another whose check digit is wrong, a
social security number another valid one, an account number (IBAN) another whose check digits are
right, a date another date in the same notation, an address another address. A telephone number is
taken for one only in a notation that says so (a plus sign, an area code in parentheses or with a
trunk zero, a national grouping, a word such as tel before it), never for its grouped digits alone. Where a notation holds only some values of the permuted set (a date that can only
be read month first, or that has a field of one digit), the permutation is repeated until it lands
on one of them. So a pseudonym has the kind of what it stands for: it is recognised, equal values
stay linked in all documents, and whoever holds the key can undo it with `undo`, in whole texts too.
Separators stay where they are. The name of a mailbox is replaced by a keyed digest, which cannot be
undone; leading zeros of address parts are not kept.

A text is cut at the matches of one pattern and joined again with the pseudonyms between the parts.

Defined results: a null text stays null, with counts of zero; null and repeated ids are kept row by
row; an empty table gives an empty result; other columns are not read, so their names cannot clash.
Texts are treated whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import let

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card", "number", "iban")
#: Order matters: at one place the first alternative that fits is taken.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
}
#: Digits in groups are a telephone number only in a notation that says so: table cells, years and measurements are not. In order: international, of any grouping; North American with dashes,
#: points or an area code in parentheses; with a trunk zero, an area code and one or two unlike groups; French, five pairs; and any grouping behind a word that announces one.
PHONES = (
    r"(?<![0-9A-Za-z+])\+[0-9](?:(?: ?\(|\)[ .-]?|[ ./-])?[0-9]){7,14}(?![0-9])",
    r"(?<![0-9A-Za-z+.-])(?:\([2-9][0-9]{2}\) ?[0-9]{3}[.-][0-9]{4}|[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])",
    r"(?<![0-9A-Za-z+.,-])(?<![0-9][ /])(?:\(0[1-9][0-9]{0,3}\) ?|0[1-9][0-9]{1,3}[ /-])(?:[0-9]{5,8}|[0-9]{3}[ -][0-9]{4,5}|[0-9]{4}[ -][0-9]{3,4})(?![0-9]|[ .,/-][0-9])",
    r"(?<![0-9A-Za-z+.,])(?<![0-9][ .-])0[1-9](?:[ .][0-9]{2}){4}(?![0-9]|[ .-][0-9])",
    r"(?=[0-9(])(?<=\b(?i:tel|telefon|telephone|phone|fax|mobil|mobile|call)\.?:? {0,2})(?:\([0-9]{1,5}\)|[0-9])(?:[ ./-]?[0-9]){6,14}(?![0-9])",
)
PATTERNS["phone"] = "|".join(PHONES)
PATTERNS["iban"] = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
PATTERN = "|".join(PATTERNS[k] for k in ("email", "ip", "date", "ssn", "iban", "card", "phone"))
#: Days that dates are permuted among, from a first one on: 400 years, or 100 years if the year has two digits; the numbers of days are the products.
LONG_YEARS, SHORT_YEARS = ("1800-01-01", 189, 773), ("1950-01-01", 75, 487)
#: Numbers of first parts (001 to 899 but 666), second and third parts of social security numbers.
SSN_PARTS = (898, 99, 9999)
#: At most so many steps until a permuted date has its notation again; two of five dates are enough for one in 10^14 to be left after that.
WALK = 64


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn's sum of a digit string; double_last: its last digit is one of those doubled."""
    n = F.length(digits)

    def step(acc: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        doubled = ((n - k) % 2) == (0 if double_last else 1)
        return acc + F.when(doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, key: str, tweak: str, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """The permuted parts as struct(l, r): in turn, each part is moved by a keyed function of the other."""

    def moved(x: Column, k: Column, size: Column, by: Column) -> Column:
        word = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), k.cast("string"), size_left.cast("string"), size_right.cast("string"), by.cast("string")), 256), 1, 15), 16, 10).cast("long")
        return F.pmod(x - F.pmod(word, size), size) if undo else F.pmod(x + F.pmod(word, size), size)

    def step(acc: Column, k: Column) -> Column:
        even = (k % 2) == 0
        return F.struct(
            F.when(even, moved(acc["l"], k, size_left, acc["r"])).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(moved(acc["r"], k, size_right, acc["l"])).alias("r"),
        )

    order = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permuted_digits(digits: Column, key: str, tweak: str, undo: bool = False) -> Column:
    """A digit string (2 to 36 digits) permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    parts = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), power(half), power(rest), key, tweak, undo=undo)
    return let(parts, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), rest, F.lit("0"))))


def refilled(shape: Column, digits: Column, skip: Column | None = None) -> Column:
    """shape with its digits, after the first `skip` ones, replaced in order by those of a string."""
    skip = F.lit(0) if skip is None else skip
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        fresh = F.when(is_digit & (acc["seen"] >= skip), F.substring(digits, acc["seen"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], fresh).alias("out"), (acc["seen"] + is_digit.cast("int")).alias("seen"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def date_reading(s: Column) -> Column:
    """struct(order, day) of a string in one of the notations: year first, day first, or, only if that is no date, month first; nulls if none fits."""
    p = F.split(s, "[./-]")
    a, b, c = (F.get(p, F.lit(k)) for k in range(3))
    two = lambda x: F.lpad(x, 2, "0")
    day = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, two(m), two(d)), F.lit("yyyy-MM-dd")).cast("date")
    year = F.when(F.length(c) == 2, F.concat(F.when(c < "50", "20").otherwise("19"), c)).otherwise(c)
    first, days = F.lit(LONG_YEARS[0]).cast("date"), LONG_YEARS[1] * LONG_YEARS[2]
    known = lambda d: F.when(F.datediff(d, first).between(0, days - 1), d)
    ymd, dmy, mdy = F.when(F.contains(s, F.lit("-")), day(a, b, c)), F.when(~F.contains(s, F.lit("-")), day(year, b, a)), F.when(F.contains(s, F.lit("/")), day(year, a, b))
    found = F.array(*(F.struct(F.lit(n).alias("order"), known(d).alias("day")) for n, d in (("ymd", ymd), ("dmy", dmy), ("mdy", mdy))))
    return F.get(F.filter(found, lambda x: x["day"].isNotNull()), F.lit(0))


def _unpadded(s: Column) -> Column:
    return s.rlike("(?:^|[./])[0-9][./]")


def shown_date(day: Column, order: Column, like: Column) -> Column:
    """A date in the notation of `like`."""
    sep, bare = F.regexp_extract(like, "[./-]", 0), _unpadded(like)
    d, m = (F.when(bare, f(day).cast("string")).otherwise(F.lpad(f(day).cast("string"), 2, "0")) for f in (F.dayofmonth, F.month))
    y = F.when(like.rlike("[./-][0-9]{2}$") & (order != "ymd"), F.date_format(day, "yy")).otherwise(F.date_format(day, "yyyy"))
    return F.when(order == "ymd", F.concat_ws("-", y, m, d)).when(order == "dmy", F.concat(d, sep, m, sep, y)).otherwise(F.concat(m, sep, d, sep, y))


def permuted_date(s: Column, key: str, undo: bool = False) -> Column:
    """A date string permuted among those of its notation."""
    short = s.rlike("/[0-9]{2}$")
    of = lambda k: F.when(short, F.lit(SHORT_YEARS[k])).otherwise(F.lit(LONG_YEARS[k]))
    first, left, right = of(0).cast("date"), of(1), of(2)

    def walked(r: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            n = F.datediff(acc["day"], first)
            moved = let(feistel(F.floor(n / right), n % right, left, right, key, "date", undo=undo), lambda p: F.date_add(first, (p["l"] * right + p["r"]).cast("int")))
            judged = let(moved, lambda d: let(shown_date(d, r["order"], s), lambda t: F.struct(d.alias("day"), t.alias("shown"), ((date_reading(t)["order"] == r["order"]) & (_unpadded(t) == _unpadded(s))).alias("done"))))
            return F.when(acc["done"], acc).otherwise(judged)

        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(r["day"].alias("day"), s.alias("shown"), F.lit(False).alias("done")), step)["shown"]

    return let(date_reading(s), walked)


def permuted_ssn(digits: Column, key: str, undo: bool = False) -> Column:
    """Nine digits of a valid social security number permuted among those of all valid ones."""
    part = lambda at, n: F.substring(digits, at, n).cast("long")
    area, group, serial = part(1, 3) - 1, part(4, 2) - 1, part(6, 4) - 1
    area = area - (area >= 666).cast("long")
    sizes = (F.lit(SSN_PARTS[0] * SSN_PARTS[1]), F.lit(SSN_PARTS[2]))

    def shown(p: Column) -> Column:
        a = F.floor(p["l"] / SSN_PARTS[1])
        a = a + (a >= 665).cast("long") + 1
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat(pad(a, 3), pad(p["l"] % SSN_PARTS[1] + 1, 2), pad(p["r"] + 1, 4))

    return let(feistel(area * SSN_PARTS[1] + group, serial, *sizes, key, "ssn", undo=undo), shown)


def _check_digit(body: Column) -> Column:
    return F.pmod(F.lit(10) - luhn_sum(body, True) % 10, F.lit(10))


def permuted_number(digits: Column, key: str, undo: bool = False) -> Column:
    """A number whose last digit is not its check digit permuted among those; the last digit keeps a keyed distance of 1 to 9 from the check digit."""
    body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1)).cast("int")
    turn = lambda b: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("turn"), b), 256), 1, 8), 16, 10).cast("long"), F.lit(9))
    gap = F.pmod(last - _check_digit(body), F.lit(10)) - 1  # 0 to 8

    def shown(b: Column) -> Column:
        moved = F.pmod(gap - turn(body), F.lit(9)) if undo else F.pmod(gap + turn(b), F.lit(9))
        return F.concat(b, F.pmod(_check_digit(b) + moved + 1, F.lit(10)).cast("string"))

    return let(permuted_digits(body, key, "number", undo), shown)


def iban_check(account: Column) -> Column:
    """The two check digits that belong to an account number without spaces."""
    n = F.length(account)
    turned = F.concat(F.substring(account, F.lit(5), n - 4), F.substring(account, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def permuted_iban(m: Column, key: str, undo: bool = False) -> Column:
    """An account number whose digits behind the check are permuted among those of its notation; country, letters and spaces stay, and the check digits fit again."""
    digits = digits_of(m)
    fresh = refilled(m, permuted_digits(F.substring(digits, F.lit(3), F.length(digits)), key, "iban", undo), F.lit(2))
    return let(fresh, lambda x: F.concat(F.substring(x, 1, 2), iban_check(F.replace(x, F.lit(" "), F.lit(""))), F.substring(x, F.lit(5), F.length(x))))


def kind_of(m: Column) -> Column:
    """The kind of a match that passes the checks of its kind, else null."""
    n = F.length(digits_of(m))
    iban = F.replace(m, F.lit(" "), F.lit(""))
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    plain = m.rlike(r"^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}$|^[0-9]{13,19}$")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike("^[A-Z]"), F.when(F.length(iban).between(15, 34) & (iban_check(iban) == F.substring(iban, 3, 2)), "iban"))
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}([/.])[0-9]{1,2}\1(?:[0-9]{4}|[0-9]{2})$"), F.when(date_reading(m).isNotNull(), "date"))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), "ssn"))
        # In groups only what passes the check is a number, and a row of years is none.
        .when(m.rlike(r"^(?:(?:1[89]|20)[0-9]{2}[ -]){3}(?:1[89]|20)[0-9]{2}$"), None)
        .when(plain & n.between(13, 19), F.when(luhn_sum(digits_of(m), False) % 10 == 0, "card").when(m.rlike("^[0-9]+$"), "number"))
        .when(~plain & n.between(7, 15), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str, undo: bool = False) -> Column:
    """What a match of a kind is replaced by."""
    digits = digits_of(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = let(permuted_digits(body, key, "card", undo), lambda b: F.concat(b, _check_digit(b).cast("string")))
    octet = F.split(m, r"\.")
    part = lambda k: F.get(octet, F.lit(k)).cast("long")
    address = let(
        feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, "ip", undo=undo),
        lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))),
    )
    # The country code stays, or the area code of a national number, so that the number remains one of its country and notation.
    first = F.length(F.coalesce(F.nullif(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(/-])", 1), F.lit("")), F.regexp_extract(m, r"^\(?([0-9]{2,5})(?=[ .)/-])", 1)))
    code = F.when(F.length(digits) - first >= 4, first).otherwise(0)
    subscriber = permuted_digits(F.substring(digits, code + 1, F.length(digits)), key, "phone", undo)
    if undo:
        mailbox = m
    else:
        mailbox = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lower(m)), 256), 1, 12), F.lit("@mail.invalid"))
    return (
        F.when(kind == "email", mailbox)
        .when(kind == "ip", address)
        .when(kind == "date", permuted_date(m, key, undo))
        .when(kind == "ssn", refilled(m, permuted_ssn(digits, key, undo)))
        .when(kind == "phone", refilled(m, subscriber, code))
        .when(kind == "card", refilled(m, card))
        .when(kind == "number", refilled(m, permuted_number(digits, key, undo)))
        .when(kind == "iban", permuted_iban(m, key, undo))
    )


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """doc_id, the text with pseudonyms, and the number of replacements of each kind. undo: from pseudonyms back to the values, but for mailboxes."""
    text = F.col("text")
    # Without a digit or an at sign nothing can match.
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("m", F.coalesce(matches, F.array().cast("array<string>")))
    judged = F.transform("m", lambda m: let(kind_of(m), lambda k: F.struct(k.alias("k"), F.coalesce(pseudonym(m, k, key, undo), m).alias("p"))))
    named = named.withColumn("found", F.when(F.size("m") > 0, judged).otherwise(F.array().cast("array<struct<k:string,p:string>>")))
    rebuilt = F.array_join(F.flatten(F.zip_with(F.split(text, PATTERN, -1), "found", lambda part, f: F.array(part, F.coalesce(f["p"], F.lit(""))))), "")
    count = lambda kind: F.size(F.filter("found", lambda f: f["k"] == kind)).cast("long").alias(f"n_{kind}")
    return named.select("doc_id", F.when(F.size("found") > 0, rebuilt).otherwise(text).alias("text"), *(count(k) for k in KINDS))
