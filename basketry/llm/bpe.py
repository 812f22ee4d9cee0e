"""BPE encoding by speculation and verification, and decoding, for a tokenizer file with word ends.

Text is normalised (NFC, white space to one space, lower case) and cut into pieces as the file says.
Greedy longest match proposes the tokens of each new piece. A sequence of tokens is the exact BPE
result if and only if every adjacent pair is: merging the joined text of the pair gives the pair
back. All adjacent pairs of all proposals of a batch are tested together against the verdicts known
so far, as one sorted array of integers; only pairs never met before are merged exactly, and only
pieces with a failing pair are merged as a whole.

Text between white space is encoded on its own, so its ids are kept in a bounded table for reuse.

Defined results: a null text is the empty text (no ids, empty decoded text); null and repeated ids
are kept row by row; an empty table gives an empty result; other columns are not read. Texts are
encoded whole. Special tokens of the file stand for themselves, and the text between them is encoded
as texts by themselves. Where Python's Unicode tables could differ from the library's (from U+0250 on,
and for four control characters that only Python takes for white space), the library's own normaliser
and splitter give the pieces; proposal, pair check and merging are the same for all pieces.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import text_or_empty
from basketry.llm.packing import ByteEncoder

ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of the table of encoded words, and of known pairs, before either starts afresh.
TABLE_ROWS = 250_000
#: Code points from which the library's tables normalise and split: the scripts below are the same in all Unicode versions in use.
PLAIN_BELOW = 0x250
#: White space for Python, but not for the file.
CONTROLS = "\x1c\x1d\x1e\x1f"


def plain(text: str) -> bool:
    """Whether Python's tables normalise and split a text as the library's do."""
    return (text.isascii() or max(text) < chr(PLAIN_BELOW)) and not any(c in text for c in CONTROLS)


class SpeculativeBpe:
    """Encoder for a BPE file whose last unit of a piece carries an end suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in self.vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens must be matched as they stand")
        self.specials = {t["content"]: t["id"] for t in added}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")") if added else None
        self.names |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        cut = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(cut["pattern"]["Regex"])
        self.alphabet = ByteEncoder._printable()
        self.byte_of = {c: b for b, c in self.alphabet.items()}
        #: Length of the longest token by its first two characters.
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 0), len(t))
        self.size = len(self.names)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.pieces: dict[str, tuple[int, ...]] = {}
        #: Special tokens go by their content after a space, which no word holds: in lower case a word may look like one.
        self.fixed = {f" {t}": (np.asarray([i], "<u4").tobytes(), t) for t, i in self.specials.items()}
        self.words: dict[str, tuple[bytes, str]] = dict(self.fixed)
        self.good = np.empty(0, np.int64)
        self.bad = np.empty(0, np.int64)
        self.stats = {"pieces": 0, "pairs_merged": 0, "merged_whole": 0}

    def merge_whole(self, piece: str) -> tuple[int, ...]:
        """ids of a piece by exact merging, as the library's own model does it."""
        return tuple(t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, piece.encode()))))

    def merge(self, units: list[str]) -> list[str]:
        """Exact merging of a pair's units: the pair of least rank first, the leftmost of equals."""
        units = list(units)
        while len(units) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(units, units[1:], strict=False)]
            low = min(ranks)
            if low == len(self.rank):
                break
            k = ranks.index(low)
            units[k : k + 2] = [units[k] + units[k + 1]]
        return units

    def propose(self, piece: str) -> list[int]:
        """Greedy longest match over the units of a piece; the last unit is one together with the suffix."""
        s = "".join(map(self.alphabet.__getitem__, piece.encode()))
        body, s, out, at, vocab, reach = len(s), s + self.suffix, [], 0, self.vocab, self.reach
        while (t := vocab.get(s[at:])) is None:
            for end in range(min(body - 1, at + reach.get(s[at : at + 2], 1)), at, -1):
                if (t := vocab.get(s[at:end])) is not None:
                    break
            out.append(t)
            at = end
        out.append(t)
        return out

    def _pair_holds(self, key: int) -> bool:
        left, right = self.names[key // self.size], self.names[key % self.size]
        bare = right.removesuffix(self.suffix) if right.endswith(self.suffix) else right
        units = [*left, *bare]
        if bare is not right:
            units[-1] += self.suffix
        return self.merge(units) == [left, right]

    def encode_pieces(self, pieces: list[str]) -> None:
        """Adds the ids of pieces, all new, to self.pieces."""
        proposals = [self.propose(p) for p in pieces]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposals)), sizes)
        inner = owner[1:] == owner[:-1]
        keys = (flat[:-1] * self.size + flat[1:])[inner]
        new = np.setdiff1d(np.setdiff1d(keys, self.good, assume_unique=False), self.bad)
        if len(self.good) + len(self.bad) > 4 * TABLE_ROWS:
            self.good = self.bad = np.empty(0, np.int64)
            new = np.unique(keys)
        holds = np.fromiter((self._pair_holds(k) for k in new.tolist()), bool, len(new))
        self.good, self.bad = np.union1d(self.good, new[holds]), np.union1d(self.bad, new[~holds])
        failing = set(owner[:-1][inner][np.isin(keys, self.bad)].tolist())
        for k, p in enumerate(pieces):
            self.pieces[p] = self.merge_whole(p) if k in failing else tuple(proposals[k])
        self.stats["pieces"] += len(pieces)
        self.stats["pairs_merged"] += len(new)
        self.stats["merged_whole"] += len(failing)

    def split(self, word: str) -> list[str]:
        """The pieces of a word as the file cuts them."""
        if plain(word):
            return self.piece.findall(word)
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]

    def learn(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """(ids as bytes, decoded text) of each word, a word being normalised text without white space."""
        cut = {w: self.split(w) for w in words}
        new = list(dict.fromkeys(p for ps in cut.values() for p in ps if p not in self.pieces))
        if new:
            self.encode_pieces(new)
        out = {}
        for w, ps in cut.items():
            ids = [t for p in ps for t in self.pieces[p]]
            out[w] = (np.asarray(ids, "<u4").tobytes(), self.decoded(ids))
        if len(self.pieces) > TABLE_ROWS:
            self.pieces = {}
        return out

    def decoded(self, ids: Iterable[int]) -> str:
        """Names of the ids, space-joined: the file has no decoder, so this is what the library returns."""
        return " ".join(map(self.names.__getitem__, ids))

    def words_between(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if not plain(text):
            return [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()

    def words_of(self, text: str) -> list[str]:
        """The normalised words of a text, and its special tokens under their names in the table of words."""
        if not any(t in text for t in self.specials):
            return self.words_between(text)
        return [w for k, part in enumerate(self.special.split(text)) for w in ([f" {part}"] if k % 2 else self.words_between(part))]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        words = [self.words_of(t) for t in texts]
        known = self.words
        missing = {w for ws in words for w in ws if w not in known}
        if len(known) + len(missing) > TABLE_ROWS:
            if len(known) > TABLE_ROWS // 2:
                known = self.words = dict(self.fixed)
                missing = {w for ws in words for w in ws if w not in known}
        got = known | self.learn(missing) if missing else known
        if missing and len(got) <= TABLE_ROWS:
            self.words = got
        out = []
        for ws in words:
            pairs = [got[w] for w in ws]
            out.append((b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs if p[1]])))
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def _batches(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Documents of a batch in runs of about `most` characters, so that a run's words fit in memory."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for ids, texts in _batches(batch):
                yield columns(ids, bpe.encode_batch(texts))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids and decoded text of each document. path: the tokenizer file."""

    def columns(ids, rows):
        arrays = [pa.array(ids, pa.int64()), pa.array([np.frombuffer(r[0], "<u4").astype("i4") for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    return _mapped(docs, path, id_col, text_col, ENCODED, columns)


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and SHA-256 digests of ids and decoded text of each document; the texts stay in their tasks."""

    def columns(ids, rows):
        arrays = [
            pa.array(ids, pa.int64()),
            pa.array([len(r[0]) // 4 for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()),
            pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, path, id_col, text_col, DIGESTS, columns)
