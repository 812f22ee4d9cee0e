"""SimHash near-duplicates with bit-sliced comparison.

The fingerprint of a text is the bitwise majority of the XXH64 hashes of its word shingles. Two
distinct fingerprints are compared if they agree on all but `radius` of several blocks of bits: any
pair within the radius does. Rows of a task are ordered by bucket and stored as bit planes, one word
of a plane holding one bit of 64 rows. All rows are compared with the row s places further on at
once: the planes are combined with themselves shifted by s bits, and carry-save counters, themselves
bit planes, add up the differences of 64 pairs at a time. Words in which every pair has exceeded the
radius are abandoned. A bucket that is larger than a tile is first split by stripes of bits, one more
than the radius, of which any pair within the radius shares one; only what is still larger than a
tile, and so alike in even more bits, is dealt out to tasks by pairs of tiles.

Each task returns a spanning forest of the links that it found, so a group of copies never becomes
all its pairs. Components are then found over the forests.

Defined results: a null text is the empty text, with the fingerprint zero; texts with fewer words
than a shingle count as one shingle; rows with a null id get the component of their fingerprint; a
component all of whose ids are null has a null id; repeated rows are kept; an empty table gives an
empty result; other columns are not read by `near_duplicates` and pass untouched through
`keep_one_of_each`. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty, unused
from basketry.llm.components import components

SEED = 42
#: Rows of a bucket that are compared within one task; larger buckets are dealt out by pairs of tiles.
TILE = 4096
#: Bytes of hashes that are turned into bits at a time.
HASH_RUN = 1 << 16


def fingerprint(text: str, shingle: int = 4) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASH_RUN):
        part = hashes[at : at + HASH_RUN].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = 4) -> DataFrame:
    """docs with the fingerprint as a signed 64-bit integer."""
    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.withColumn(name, fp(text_or_empty(text_col)))


def blocks_for(rows: int, radius: int) -> int:
    """Number of blocks: the least for which the keys have about as many values as there are rows."""
    for blocks in range(radius + 1, radius + 5):
        if (64 // blocks) * (blocks - radius) >= max(rows, 2).bit_length() - 1:
            return blocks
    return radius + 4


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(block[k] for k in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BitSlices:
    """The bit planes of a run of fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.rows = len(fps)
        words = -(-self.rows // 64)
        bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        padded = np.zeros((64, (words + 1) * 64), np.uint8)
        padded[:, : self.rows] = bits.T
        self.planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def within(self, shift: int, alive: np.ndarray, radius: int) -> np.ndarray:
        """Rows i for which rows i and i + shift differ in at most `radius` bits. alive: bits of the rows to look at, by word.

        The counters count to seven and then stay above: ones, twos and fours, with `over` for an
        overflow of fours. The radius must be below eight.
        """
        at = np.flatnonzero(alive)
        live = alive[at]
        hop, turn = divmod(shift, 64)
        last = self.planes.shape[1] - 1
        ones, twos, fours, over = (np.zeros(len(at), np.uint64) for _ in range(4))
        for k in range(64):
            p = self.planes[k]
            far = p[np.minimum(at + hop, last)]
            if turn:
                far = (far >> np.uint64(turn)) | (p[np.minimum(at + hop + 1, last)] << np.uint64(64 - turn))
            d = p[at] ^ far
            carry = ones & d
            ones ^= d
            up = twos & carry
            twos ^= carry
            over |= fours & up
            fours ^= up
            if k % 4 == 3 and k >= 2 * radius:
                live &= ~(over | _above(ones, twos, fours, radius))
                keep = live != 0
                if not keep.all():
                    at, live, ones, twos, fours, over = (x[keep] for x in (at, live, ones, twos, fours, over))
                    if not len(at):
                        return np.empty(0, np.int64)
        bits = np.unpackbits(np.ascontiguousarray(live).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return at[word] * 64 + bit


def _above(ones, twos, fours, radius: int):
    """Bits whose counter of three bits exceeds the radius."""
    above, equal = np.zeros_like(ones), np.full_like(ones, 0xFFFFFFFFFFFFFFFF)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def forest(fps: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each run of `sizes`, the runs being in decreasing order of size."""
    n = len(fps)
    slices = BitSlices(fps)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(n)  # rows from here to the end of the run
    out = []
    for shift in range(1, int(sizes[0]) if len(sizes) else 0):
        count = int(ends[np.searchsorted(-sizes, -shift, side="left") - 1])  # rows of runs longer than shift
        mask = np.zeros(-(-count // 64) * 64, np.uint8)
        mask[:count] = left[:count] > shift
        for i in slices.within(shift, np.packbits(mask, bitorder="little").view("<u8"), radius).tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                parent[a] = b
                out.append((i, i + shift))
    return out


def _links(radius: int, most: int = 1 << 19):
    """Compares the rows (key, tile, fp) of a task, ordered by key and tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 2

        def compared(keys: np.ndarray, fps: np.ndarray):
            if not len(keys):
                return
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(first, len(keys)))
            order = np.argsort(-sizes, kind="stable")
            order = order[sizes[order] > 1]
            if not len(order):
                return
            rows = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in order]) if len(order) < 1000 else _ranges(first[order], sizes[order])
            own = fps[rows]
            links = forest(own.view(np.uint64), sizes[order], radius)
            if links:
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], names=["u", "v"])

        for batch in batches:
            keys, fps = (np.concatenate((h, batch.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held))
            if len(keys) >= most:  # all but the last bucket, which may go on
                whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                yield from compared(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
            held = [keys, fps]
        yield from compared(*held)

    return run


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges [first, first + size)."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)


def _large(keyed: DataFrame, tile: int) -> DataFrame:
    """The keys of more rows than a tile, with their numbers of tiles."""
    return keyed.groupBy("key").count().where(F.col("count") > tile).select(F.col("key").alias("large_key"), F.ceil(F.col("count") / (tile / 2)).cast("int").alias("tiles"))


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (u, v) between the distinct values of the column fp, enough of them to connect all that are within the radius."""
    key_of = lambda name, masks: F.explode(F.array(*(F.xxhash64(*name, F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)))).alias("key")
    # A bucket's name: which blocks it fixes, and their bits.
    keyed = fps.select("fp", key_of([], _masks(blocks_for(fps.count(), radius), radius)))
    large = cut(_large(keyed, tile).select("large_key"))
    is_large = F.col("key") == F.col("large_key")
    stripes = [sum(1 << bit for bit in range(k, 64, radius + 1)) for k in range(radius + 1)]
    finer = keyed.join(large, is_large, "left_semi").select("fp", key_of(["key"], stripes))
    split = finer.join(_large(finer, tile), is_large, "left")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.coalesce("tiles", F.lit(1))).cast("int")
    # A row of tile a goes to the tasks of all pairs that hold a.
    pairs = F.when(F.col("tiles").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda b: F.xxhash64(F.col("key"), F.least(own, b), F.greatest(own, b)))
    )
    dealt = keyed.join(large, is_large, "left_anti").select("key", "fp").unionByName(split.select(F.explode(pairs).alias("key"), "fp"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "u long, v long")


def _classes(prints: DataFrame, radius: int, tile: int, first: str = "doc_id") -> DataFrame:
    """fp, component_id, root and first_id of each distinct fingerprint of prints (doc_id, fp); ids are the least values of the column `first`.

    Only fingerprints with a link take part in the naming. The names are written before the join, so
    that both of its sides are plain exchanges and Spark can split a root that most rows share.
    """
    firsts = cut(prints.groupBy("fp").agg(F.min(first).alias("first_id")))
    linked = cut(firsts.join(components(links(firsts.select("fp"), radius, tile)), F.col("fp") == F.col("node")).select("node", "root", "first_id"))
    named = cut(linked.groupBy(F.col("root").alias("named_root")).agg(F.min("first_id").alias("least_id")))
    names = linked.join(named, F.col("root") == F.col("named_root")).select("node", "root", "least_id")
    joined = firsts.join(names, F.col("fp") == F.col("node"), "left")
    return joined.select(F.col("fp").alias("class_fp"), F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"), "first_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut(with_fingerprint(named, "text", "fp", shingle).select("doc_id", "fp"))
    joined = prints.join(_classes(prints, radius, tile), F.col("fp") == F.col("class_fp"))
    return joined.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, tile: int = TILE) -> DataFrame:
    """The documents, one for each component: the one with the least id, null ids last.

    Of rows with that id the one whose text has the least digest is kept, and one of equal rows.
    Columns of docs may have any names.
    """
    own, digest, place, best_id, best_digest = (unused(docs, n) for n in ("own_id", "digest", "place", "best_id", "best_digest"))
    marked = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), digest: F.xxhash64(F.col(text_col))})
    # Fingerprints are made once; the rows are found again by their id and a digest that costs little.
    prints = cut(with_fingerprint(marked.select(F.struct(F.col(own).alias("i"), F.col(digest).alias("d")).alias("doc"), F.col(text_col).alias("text")), "text", "fp", shingle).select("doc", "fp"))
    classes = _classes(prints, radius, tile, "doc")
    best = classes.groupBy("root").agg(F.min("first_id").alias("best")).select(F.col("best.i").alias(best_id), F.col("best.d").alias(best_digest))
    kept = marked.join(best, (F.col(own) == F.col(best_id)) & (F.col(digest) == F.col(best_digest)), "left_semi")
    # Groups are only as large as a row is repeated.
    w = Window.partitionBy(own, digest).orderBy(F.lit(0))
    return kept.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).select(*docs.columns)
