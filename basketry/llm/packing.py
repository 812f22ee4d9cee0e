"""Packing of token sequences by minimum bin slack, with cuts only where no multiset fills a window.

A document is its ids followed by one end id. Whole windows of it are sequences by themselves; what
remains (fewer ids than a window) is packed with the remainders of other documents. Remainders are
kept by length, as counts. For each window the longest remainder is the anchor, and a subset-sum
dynamic programme over a bitset picks the multiset of remaining lengths that comes closest to the
capacity left; the chosen counts are found by backtracking, and the same window is repeated as often
as the counts allow. If no multiset closes the window, one remainder is cut to close it and what is
left of it goes back to the lengths. Only the end of a block can be short: it is cut at powers of
two, which need no padding.

Blocks are the remainders of at most `block` documents of one partition, so no row is shuffled and
the memory of a task is bounded whatever the sizes of groups of copies.

Defined results: a null text is the empty text, so its document is the end id alone; null and
repeated document ids are packed row by row; an empty table gives no pieces; other columns are not
read. Texts are encoded whole, in slices of documents that keep each document's ids together.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The low bits of a sequence id count the sequences of a partition; the high ones are the partition.
PARTITION_SHIFT = 40


class ByteEncoder:
    """ids of a byte-level BPE file of the tokenizers library, special tokens in a text included.

    The merging is done by tiktoken over the vocabulary of that file, which gives the same ids in a
    quarter of the time; its ranks are the ids of the file.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        # What makes merging by ranks the same as merging by the file's list.
        if order != sorted(order) or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"] or (before["type"], before["add_prefix_space"], before["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError(f"{path} is not a plain byte-level file with merges in the order of their ids")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must be matched as they stand")
        to_byte = {c: b for b, c in self._printable().items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in to_byte for c in token)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {b: i for b, i in ranks.items() if i not in added.values()}
        self.merges = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    @staticmethod
    def _printable() -> dict[int, str]:
        """The published byte alphabet: printable bytes stand for themselves, the others follow from code point 256."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def encode(self, text: str) -> np.ndarray:
        if not self.added or not any(t in text for t in self.added):
            return np.asarray(self.merges.encode_ordinary(text), dtype="<u4")
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += self.merges.encode_ordinary(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return np.asarray(out + self.merges.encode_ordinary(text[at:]), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def best_fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(sum, count by length) of the multiset of available lengths whose sum is closest to room, not above it.

    The bitset holds the sums that can be reached; each step adds a length in binary multiples and
    keeps the bitset before it, so that the counts can be read off backwards.
    """
    if room <= 0:
        return 0, {}
    if counts.get(room, 0):
        return room, {room: 1}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if 0 < n <= room and counts[n] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    best = total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return best, chosen


def pack_remainders(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (index of the remainder, from, to); each unit of each remainder lies in one of them."""
    runs: dict[int, deque] = {}
    for k, n in enumerate(lengths):
        if n:
            runs.setdefault(n, deque()).append((k, 0, n))
    counts = {n: len(r) for n, r in runs.items()}
    windows: list[list[tuple[int, int, int]]] = []

    def take(n: int):
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return runs[n].popleft()

    def put(piece) -> None:
        n = piece[2] - piece[1]
        runs.setdefault(n, deque()).append(piece)
        counts[n] = counts.get(n, 0) + 1

    while counts:
        anchor = max(counts)
        counts[anchor] -= 1
        total, chosen = best_fill(counts, capacity - anchor)
        counts[anchor] += 1
        slack = capacity - anchor - total
        need = dict(chosen)
        need[anchor] = need.get(anchor, 0) + 1
        if not slack:
            for _ in range(min(counts[n] // c for n, c in need.items())):
                windows.append([take(n) for n, c in need.items() for _ in range(c)])
            continue
        window = [take(n) for n, c in need.items() for _ in range(c)]
        if counts:
            k, lo, hi = take(max(counts))
            window.append((k, lo, lo + slack))
            put((k, lo + slack, hi))
            windows.append(window)
        else:
            windows += at_powers_of_two(window)
    return windows


def at_powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The last, short window as windows whose sizes are powers of two, the largest first."""
    left, out = deque(window), []
    total = sum(hi - lo for _, lo, hi in window)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        own = []
        while room:
            k, lo, hi = left.popleft()
            used = min(room, hi - lo)
            own.append((k, lo, lo + used))
            if lo + used < hi:
                left.appendleft((k, lo + used, hi))
            room -= used
        out.append(own)
    return out


def pieces_of(rows: Iterable[tuple[object, np.ndarray]], first: int, capacity: int, block: int) -> Iterator[tuple]:
    """The pieces of documents (id, ids), numbered from sequence `first`."""
    held: list[tuple[object, int, np.ndarray]] = []
    sequence = first

    def flush():
        nonlocal sequence
        for window in pack_remainders([len(h[2]) for h in held], capacity):
            offset = 0
            for k, lo, hi in window:
                doc, begin, ids = held[k]
                yield doc, begin + lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), begin + len(ids), sequence, offset
                offset += hi - lo
            sequence += 1
        held.clear()

    for doc, ids in rows:
        whole = len(ids) - len(ids) % capacity
        for at in range(0, whole, capacity):
            yield doc, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), len(ids), sequence, 0
            sequence += 1
        if whole < len(ids):
            held.append((doc, whole, ids[whole:].copy()))
            if len(held) >= block:
                yield from flush()
    yield from flush()


def pack(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1024, block: int = 16384) -> DataFrame:
    """One row for each piece of a document; see PIECES. vocabulary: the path of the tokenizer file."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode
        first = TaskContext.get().partitionId() << PARTITION_SHIFT
        end = np.asarray([end_id], dtype="<u4")

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, np.concatenate((encode(text.as_py()), end))

        out: list[tuple] = []
        for piece in pieces_of(rows(), first, capacity, block):
            out.append(piece)
            if len(out) >= 20000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
