"""Audit of how the words of each source depart from those of the other sources of its language, by sorted streams.

Tasks count the terms of their documents in blocks and emit one record for each (lang, term, source)
of a block, with the place of the block's first document, the number of documents that hold the term
and the number of its occurrences. The records are dealt out by a hash of (lang, term), sorted by it and
by lang, term, source and document, and a run-length scan adds them up; a run of too few documents is
dropped. A frequent term costs a record for each block, not for each document, so no task gets a hot term's
documents, and a scan holds one run, summed by source.

The kept counts are dealt out again, by language and a share of the terms, behind the header rows of
the groups (lang, source) with their sums. A second scan turns counts into probabilities and emits,
for its share of the terms, partial sums for the pairs of sources and its greatest terms of each
group. Terms that a group does not hold all have the same probability there, so a pair starts with
what its distance would be without any term, and each held term corrects it. Where a language has
more sources than a tile, pairs are made tile by tile, so that a task holds no more than two tiles.

All arithmetic is exact: probabilities are integers in billionths, rounded down.

Defined results: null text, lang or source is the empty string; a document without terms still names
its group; repeated rows and ids count as they stand; a language without kept terms has pairs with
the value 0 and no terms; a single source has no pairs; equal values are ranked by item, by its UTF-8
bytes; an empty table gives an empty result; other columns are not read. Texts are counted whole; one
of more than LONG bytes is read term by term, so that only its counts are held.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty

#: A term, in the bytes of a text whose A-Z are lower-cased: letters of ASCII, and whatever lies beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Added to each count, and the unit of probabilities.
SMOOTHING, UNIT = 5, 1_000_000_000
#: Different terms of a block, by group; beyond it the block is emitted.
BLOCK = 300_000
#: Bytes beyond which the terms of a text are not listed before they are counted.
LONG = 8_000_000
#: Sources of a language that a task holds at most twice; tiles of them are paired. Terms of a group that a scan collects before it keeps the greatest.
TILE, BUFFER = 256, 20_000
#: Counts of a share of the terms of a language, about.
SHARE = 100_000
#: Rows of an emitted batch.
ROWS = 50_000

RECORDS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64()), ("first", pa.bool_())])
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {"string": "string", "int64": "long", "bool": "boolean"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def terms_of(text: bytes) -> Iterator[bytes]:
    """The terms of a text one by one."""
    return (m[0] for m in TERM.finditer(text.lower()))


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text) to the records of blocks."""
    document = TaskContext.get().partitionId() << 33
    first, weight = document, 0
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emitted() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in held.items():
            # Both counters got their terms in the same order.
            terms, counts, sums = pa.array(docs, pa.binary()).cast(pa.string()), pa.array(docs.values(), pa.int64()), pa.array(n.values(), pa.int64())
            for at in range(0, len(terms), ROWS):
                some = terms[at : at + ROWS]
                same = lambda x, t: pa.repeat(pa.scalar(x, t), len(some))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang, pa.string()), some, same(source, pa.string()), same(first, pa.int64()), counts[at : at + ROWS], sums[at : at + ROWS]], schema=RECORDS)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            docs, n = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            if len(text) <= LONG:
                terms = TERM.findall(text.lower())  # of bytes: A-Z alone
                n.update(terms)
                docs.update(dict.fromkeys(terms).keys())
            else:
                n.update(terms_of(text))
                docs.update(dict.fromkeys(terms_of(text)).keys())
            document += 1
            weight += len(n) - before
            if weight > BLOCK:
                yield from emitted()
                first, weight = document, 0
    yield from emitted()


def _starts(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where runs of equal values begin."""
    if not table.num_rows:
        return np.empty(0, np.int64)
    new = np.zeros(table.num_rows - 1, bool)
    for c in columns:
        x = table[c].combine_chunks()
        new |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _collapsed(table: pa.Table) -> pa.Table:
    """One row for each run of a source within a term."""
    at = _starts(table, ("lang", "term", "source"))
    sums = {c: pa.array(np.add.reduceat(table[c].to_numpy(), at)) for c in ("docs", "n")}
    rows = table.drop_columns(list(sums)).take(pa.array(at))
    return pa.table({**{c: rows[c] for c in rows.column_names}, **sums})


def _runs(least: int):
    """From sorted records to the counts of terms that at least so many documents hold.

    A run of a key is a term, but for terms of equal hash; most runs are too short for any term and go at once.
    """

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = _collapsed(table.combine_chunks())
        at = _starts(table, ("lang", "term"))
        sizes = np.diff(np.append(at, table.num_rows))
        kept = np.repeat(np.add.reduceat(table["docs"].to_numpy(), at) >= least, sizes)
        first = np.zeros(table.num_rows, bool)
        first[at] = True
        lang_n = np.repeat(np.add.reduceat(table["n"].to_numpy(), at), sizes)
        out = table.drop_columns(["docs", "key"]).append_column("lang_n", pa.array(lang_n)).append_column("first", pa.array(first)).filter(pa.array(kept))
        yield from out.cast(KEPT).combine_chunks().to_batches(max_chunksize=ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table({c: batch.column(c) for c in ("lang", "term", "source", "key", "docs", "n")})
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = table["key"].to_numpy()
            at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            sizes = np.diff(np.append(at, len(keys)))
            # The last run may go on in the next batch.
            enough = np.add.reduceat(table["docs"].to_numpy(), at) >= least
            enough[-1] = False
            if enough.any():
                yield from finished(table.filter(pa.array(np.repeat(enough, sizes))))
            rest = _collapsed(table.slice(int(at[-1])).combine_chunks())  # a row for each source
        if rest is not None:
            yield from finished(rest)

    return run


def probability(n: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)), exactly. total: a number, or one for each n."""
    n, total = np.asarray(n, np.int64), np.asarray(total, np.int64)
    if not n.size:
        return np.zeros(0, np.int64)
    if int(n.max()) + SMOOTHING < 2**63 // UNIT and int(total.max()) < 2**62:
        return 1 + UNIT * (n + SMOOTHING) // (total + SMOOTHING * terms)
    wide = 1 + UNIT * (n.astype(object) + SMOOTHING) // (total.astype(object) + SMOOTHING * terms)
    return wide.astype(np.int64)


class Share:
    """The groups of two tiles and a share of the terms of a language."""

    def __init__(self, head: pd.DataFrame, top: int):
        self.lang, self.salt, self.top = head["lang"].iloc[0], int(head["salt"].iloc[0]), top
        self.sources = head["source"].tolist()
        self.place = {s: k for k, s in enumerate(self.sources)}
        self.tile, self.n = head["tile"].to_numpy(), head["n"].to_numpy(np.int64)
        self.terms, self.lang_n = int(head["v"].iloc[0]), int(head["lang_n"].iloc[0])
        size = len(self.sources)
        self.none = probability(np.zeros(size, np.int64), self.n, self.terms) if self.terms else np.zeros(size, np.int64)
        self.base = np.abs(self.none[:, None] - self.none[None, :])
        # The sums of the share number 0 hold what the distances would be without any term.
        self.sums = self.terms * self.base if self.salt == 0 else np.zeros((size, size), np.int64)
        self.whole = len(set(self.tile.tolist())) == 1 and bool(head["whole"].iloc[0])
        self.best: list[pd.DataFrame] = []
        self.held = 0

    def add(self, rows: pd.DataFrame) -> None:
        """Whole terms, in order: term, source, n, lang_n."""
        g = rows["source"].map(self.place).to_numpy(np.int64)
        term = np.cumsum(np.append(True, rows["term"].to_numpy()[1:] != rows["term"].to_numpy()[:-1])) - 1
        p = probability(rows["n"].to_numpy(), self.n[g], self.terms)
        every = np.tile(self.none, (int(term[-1]) + 1, 1))
        every[term, g] = p
        absent = np.ones(every.shape, bool)
        absent[term, g] = False
        for k in np.unique(g).tolist():
            t = term[g == k]
            more = np.abs(every[t, k][:, None] - every[t]) - self.base[k]
            self.sums[k] += more.sum(axis=0)
            self.sums[:, k] += np.where(absent[t], more, 0).sum(axis=0)
        if self.whole:
            over = p - probability(rows["lang_n"].to_numpy(), self.lang_n, self.terms)
            more = over > 0
            self.best.append(pd.DataFrame({"g": g[more], "value": over[more], "item": rows["term"].to_numpy()[more]}))
            self.held += int(more.sum())
            if self.held > BUFFER:
                self.best = [self.greatest()]
                self.held = len(self.best[0])

    def greatest(self) -> pd.DataFrame:
        every = pd.concat(self.best, ignore_index=True).sort_values(["g", "value", "item"], ascending=[True, False, True])
        return every.groupby("g").head(self.top)

    def emitted(self) -> Iterator[pa.RecordBatch]:
        # Within a tile by the share of that tile alone, between tiles by that of both.
        own = self.tile[:, None] == self.tile[None, :]
        wanted = own if self.whole else ~own
        np.fill_diagonal(wanted, False)
        for k in range(len(self.sources)):
            to = np.flatnonzero(wanted[k])
            if len(to):
                yield self.batch([self.sources[k]] * len(to), "pair", [self.sources[x] for x in to.tolist()], self.sums[k, to])
        if self.best:
            best = self.greatest()
            yield self.batch([self.sources[x] for x in best["g"].tolist()], "term", best["item"].tolist(), best["value"].to_numpy(np.int64))

    def batch(self, source: list, part: str, item: list, value: np.ndarray) -> pa.RecordBatch:
        same = lambda x: pa.array([x] * len(source), pa.string())
        return pa.RecordBatch.from_arrays([same(self.lang), pa.array(source, pa.string()), same(part), pa.array(item, pa.string()), pa.array(value)], schema=PARTIAL)


def _partials(top: int):
    """From rows sorted by (lang, pair, salt, term, source), with headers (no term) first, to partial sums and terms."""
    keys = ["lang", "pair", "salt"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, share, head, rest = None, None, [], None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal share, rest
            if head and share is None:
                share = Share(pd.concat(head), top)
            if share is not None:
                if rest is not None:
                    share.add(rest)
                yield from share.emitted()
            share, rest = None, None
            head.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pandas()
            new = np.any([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in keys], axis=0)
            for part in np.split(np.arange(len(rows)), np.flatnonzero(new) + 1):
                some = rows.iloc[part]
                key = tuple(some[keys].iloc[0])
                if key != now:
                    yield from closed()
                    now = key
                is_head = some["term"].isna().to_numpy()
                if is_head.any():
                    head.append(some[is_head])
                some = some[~is_head]
                if not len(some):
                    continue
                if share is None:
                    share = Share(pd.concat(head), top)
                some = some if rest is None else pd.concat([rest, some])
                # The last term may go on in the next batch.
                whole = (some["term"] != some["term"].iloc[-1]).to_numpy()
                if whole.any():
                    share.add(some[whole])
                rest = some[~whole]
        yield from closed()

    return run


def audit(docs: DataFrame, *, least: int = 30, top: int = 50, tile: int = TILE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: each other source with the distance to it (part pair), and the `top` terms that exceed their share in the language most (part term).

    least: documents of a language that must hold a term. tile: sources of a language that are paired in one task.
    """
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).cast("binary").alias("text"))
    # The hash comes first, so that two terms mostly differ in a number; strings are compared within a run. Four bytes do, since equal hashes only cost such a comparison.
    records = rows.mapInArrow(_records, ddl(RECORDS)).withColumn("key", F.hash("lang", "term"))
    kept = cut(records.repartition("key").sortWithinPartitions("key", "lang", "term", "source", "document").mapInArrow(_runs(least), ddl(KEPT)))

    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    shares = F.ceil(F.count("*") / SHARE).cast("int").alias("shares")
    by_lang = cut(kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum(F.when(F.col("first"), F.col("lang_n"))).alias("lang_n"), shares))
    named = rows.select("lang", "source").distinct()
    groups = cut(named.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n", "v", "lang_n"]).na.fill(1, ["shares"]))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = max(1, -(-most // tile))
    number = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda b: F.least("tile", b) * tiles + F.greatest("tile", b))).alias("pair")
    shown = ["lang", "pair", "salt", "term", "source", "n", "lang_n", "v", "tile", F.expr(f"pair div {tiles} = pair % {tiles}").alias("whole")]
    own = lambda df: df.withColumn("tile", number).select("*", pairs)
    headers = own(groups).withColumn("term", F.lit(None).cast("string")).select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt")).select(*shown)
    shared = kept.join(by_lang.select("lang", "shares"), "lang")
    entries = own(shared).withColumns({"salt": F.pmod(F.xxhash64("term"), F.col("shares")).cast("int"), "v": F.lit(0).cast("long")}).select(*shown)
    dealt = headers.unionByName(entries).repartition("lang", "pair", "salt").sortWithinPartitions("lang", "pair", "salt", "term", "source")
    partial = dealt.mapInArrow(_partials(top), ddl(PARTIAL))
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Of a group: its other sources, or the greatest terms of each share.
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top))
