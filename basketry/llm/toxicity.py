"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text, and the difference of their log-likelihoods.

The models are interpolated bigram models. A bigram is discounted and backs off to its word; a word
is rated by the number of distinct words that it follows and backs off to its first letters, rated
by the number of distinct words that begin so, and these to fewer letters. Backoff weights are those
of the pooled counts of both classes, so an expression that neither class holds favours neither.

Features of a text, all by the number of words: the log-likelihood difference of the whole text, what exceeds a
margin in single words, so that a few expressions count in a long text, and the difference of the
window that has the greatest. A logistic curve over them, fitted on texts that the counts did not
come from, gives the score.

The counts are made over all labelled rows; only the logistic curve is fitted on a bounded sample,
the first `max_toxic` and `max_ordinary` ids of each class by hash outside fold 0. Words are counted by
their 64-bit hashes, in blobs by the first bits of these. Of the words, beginnings and bigrams that are
more frequent than the discount, the model holds those whose counts tell more than their backoff
(a test of the likelihood ratio); the others have the difference of their backoff. It grows with the
rows, so it is not broadcast but a sorted file on the disk of each executor, of which lookups read
what they need; it passes through the driver's disk a few thousand rows at a time.

Defined results: a null text is the empty text; empty texts get the score of no evidence; null or
repeated ids are scored row by row; labels with null id or value are ignored, a document with
conflicting labels counts as toxic; without labels of both classes all texts get a score of 0.0; an
empty table gives an empty result; other columns are not read. Texts are scored whole.
"""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty

#: Documents of each class that the logistic curve is fitted on, at most.
MAX_TOXIC, MAX_ORDINARY = 4000, 8000
#: What is taken off each count: of words and their first letters, and of bigrams. Expressions that are no more frequent back off altogether.
DISCOUNT, PAIR_DISCOUNT = 3.0, 2.0
#: Numbers of first letters to which words back off, the longest first.
STEMS = (7, 6, 5, 4, 3)
#: A word whose difference exceeds this speaks for itself, also in a long ordinary text.
STRONG = 1.0
#: One in so many rows by hash lies outside fold 0; the curve is fitted on such rows.
CURVE_SHARE = 4
#: An expression is kept if its counts in the two classes depart so far from those that its backoff lets expect (twice the log-likelihood ratio; 3.84 is the 5 % point).
TELLING = 3.84
#: The window whose mean difference is the greatest speaks for the text, in words.
WINDOW = 24
#: `Model.cut` is to catch this share of toxic texts, but to lose no more than that share of ordinary ones.
RECALL, MOST_LOST = 0.99, 0.01
#: Texts shorter than this are averaged as if they had so many words.
LEAST_WORDS = 8
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def stem_of(word: str, n: int) -> str:
    """The first n letters of a word; a shorter word ends in a mark."""
    return word[:n] if len(word) >= n else f"{word}$"


def stems_of(word: str) -> list[str]:
    return [stem_of(word, n) for n in STEMS]


def hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    if not strings:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(strings, dtype=object), categorize=False)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (v * np.uint64(0x9E3779B97F4A7C15) + w).view(np.int64)


def stem_keys(stems: list[str]) -> np.ndarray:
    return hashes([f"^{s}" for s in stems]).view(np.int64)


#: The empty word, before the first word of a text.
START = hashes([""])[0]
#: The counts of a row: ordinary (o) and toxic (t), of fold 0 and of all. The curve is fitted on rows outside fold 0.
SUMS = ("o0", "oall", "t0", "tall")
FOLDS = ("0", "all")


@dataclass
class Lookup:
    """A sorted table of int64 keys and float16 values in files that Spark copies to each executor's disk; it is mapped, not loaded."""

    name: str
    n: int
    width: int

    def __post_init__(self):
        self.maps = None

    def __getstate__(self):
        return {**self.__dict__, "maps": None}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, NaN where there are none."""
        out = np.full((len(keys), self.width), np.nan, np.float32)
        if not self.n or not len(keys):
            return out
        if self.maps is None:
            self.maps = np.memmap(SparkFiles.get(f"{self.name}.keys"), np.int64, "r"), np.memmap(SparkFiles.get(f"{self.name}.values"), np.float16, "r").reshape(-1, self.width)
        known, values = self.maps
        at = np.searchsorted(known, keys)
        at[at == self.n] = 0
        hit = known[at] == keys
        out[hit] = values[at[hit]]
        return out


def publish(df: DataFrame, key: str, columns: list[str]) -> Lookup:
    """The table as a Lookup; a few thousand rows at a time pass through the driver to its disk."""
    df = cut(df.select(F.col(key).alias("key"), *(F.col(c).cast("float") for c in columns)))
    rows, name, folder = df.count(), f"lookup-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="basketry-")

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(columns))], 1).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["k", "v"])

    parts = df.repartitionByRange(rows // 1_000_000 + 1, "key").sortWithinPartitions("key").mapInArrow(blobs, "k binary, v binary")
    with open(f"{folder}/{name}.keys", "wb") as keys, open(f"{folder}/{name}.values", "wb") as values:
        for r in parts.toLocalIterator():
            keys.write(r["k"])
            values.write(r["v"])
    for kind in ("keys", "values"):
        df.sparkSession.sparkContext.addFile(f"{folder}/{name}.{kind}")
    return Lookup(name, rows, len(columns))


@dataclass
class Model:
    """Log-likelihood differences, toxic less ordinary, of bigrams, words and stems by hash, and the logistic curve over the features."""

    table: Lookup | None = None
    #: The column of the table: counts of fold 0, or of all rows.
    fold: int = 1
    curve: np.ndarray | None = None
    #: Texts with this score or more are to be taken as toxic where a stated recall counts, see `cut_of`.
    cut: float = 0.5

    def __post_init__(self):
        self.rare: dict[int, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "rare": {}}

    def _find(self, keys: np.ndarray) -> np.ndarray:
        return self.table.find(keys)[:, self.fold].astype(float)

    def _unknown(self, h: np.ndarray, words: list[str]) -> np.ndarray:
        """Differences of words that are not in the table: that of the longest known stem."""
        rare = self.rare
        if len(rare) > 100_000:
            rare.clear()
        keys = h.tolist()
        new = {k: w for k, w in zip(keys, words, strict=True) if k not in rare}
        rest = np.array(list(new.values()), dtype=object)
        out, at = np.zeros(len(rest)), np.arange(len(rest))
        for n in STEMS:
            if not len(at):
                break
            found = self._find(stem_keys([stem_of(w, n) for w in rest[at].tolist()]))
            known = ~np.isnan(found)
            out[at[known]] = found[known]
            at = at[~known]
        rare.update(zip(new, out.tolist(), strict=True))
        return np.array([rare[k] for k in keys])

    def features_of(self, texts: list[str]) -> list[tuple[float, float, float]]:
        """Mean difference per word; mean of what exceeds STRONG per word; mean difference per word of the window with the greatest."""
        split = [words_of(t) for t in texts]
        flat = [w for ws in split for w in ws]
        if not flat or self.table is None:
            return [(0.0, 0.0, 0.0)] * len(texts)
        h, ends = hashes(flat), np.cumsum([len(ws) for ws in split])
        seen, at = np.unique(h, return_inverse=True)
        llr = self._find(seen.view(np.int64))[at]
        lost = np.flatnonzero(np.isnan(llr))
        llr[lost] = self._unknown(h[lost], [flat[k] for k in lost.tolist()])
        pair = self._find(pair_keys(_before(h, ends), h))
        out = np.where(np.isnan(pair), llr, pair)
        rows = []
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            one, size = out[start:end], max(end - start, LEAST_WORDS)
            sums = np.concatenate(([0.0], np.cumsum(one)))
            long = min(WINDOW, end - start)
            peak = float((sums[long:] - sums[: len(sums) - long]).max()) / max(long, LEAST_WORDS)
            rows.append((float(sums[-1]) / size, float(np.maximum(one - STRONG, 0).sum()) / size, peak))
        return rows

    def features(self, text: str) -> tuple[float, float, float]:
        return self.features_of([text])[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        x = np.array([design(*f) for part in _some(texts) for f in self.features_of(part)]).reshape(-1, 4)
        return self.on_curve(x)

    def on_curve(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def _before(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the word before each word; texts end before the places `ends`."""
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[0] = START
    v[ends[ends < len(h)]] = START
    return v


def _some(texts: list[str], least: int = 500_000) -> Iterator[list[str]]:
    """The texts in runs of at least so many characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= least:
            yield run
            run, size = [], 0
    if run:
        yield run


def design(mean: float, strong: float, peak: float) -> np.ndarray:
    """The columns of the curve; logarithms, so that single short texts do not bend it."""
    damped = np.log1p(np.abs([10 * mean, 100 * strong, 10 * peak]))
    return np.array([1.0, *(np.copysign(damped, [mean, strong, peak]))])


BLOB = "bucket int, size long, blob binary"


def _blobs(keys: np.ndarray, bits: int, cut_out) -> Iterator[tuple[int, int, bytes]]:
    """The rows of sorted keys by their first bits, compressed. cut_out: from (start, end) to what is kept of these rows."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        raw = pickle.dumps(cut_out(int(edges[b]), int(edges[b + 1])), protocol=5)
        yield b, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _open(size: int, blob: bytes):
    return pickle.loads(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True))


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max())) if counts.size else np.uint8)


def _summed(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of rows with equal keys, in the order of keys."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(order) else np.empty(0, np.int64)
    return [k[starts] for k in keys], np.stack([np.add.reduceat(c[order], starts, dtype=np.int64) for c in counts.T], 1) if len(starts) else np.empty((0, counts.shape[1]), np.int64)


def _counted(parts: Lookup, bits: int):
    """From (id hash, text) to blobs of the bigrams of labelled rows by the hash of their second word: w, v, four counts, words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        ends: list[int] = []
        part: list[int] = []

        def flush():
            h, n = hashes(words), np.array(ends)
            of = np.repeat(np.array(part), np.diff(n, prepend=0))
            seen, first = np.unique(h, return_index=True)
            (w, v), counts = _summed((h, _before(h, n)), of[:, None] == np.arange(4))
            counts = _narrow(counts)

            def piece(start, end):
                a, b = np.searchsorted(seen, w[start]), np.searchsorted(seen, w[end - 1], "right")
                return w[start:end], v[start:end], counts[start:end], "\n".join(words[k] for k in first[a:b].tolist())

            out = list(_blobs(w, bits, piece))
            words.clear(), ends.clear(), part.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "size", "blob"])

        for batch in batches:
            of = parts.find(batch.column(0).to_numpy())[:, 0]
            for k in np.flatnonzero(~np.isnan(of)).tolist():
                words.extend(words_of(batch.column(1)[k].as_py()))
                ends.append(len(words))
                part.append(int(of[k]))
                if len(words) > 500_000:
                    yield flush()
        if words:
            yield flush()

    return run


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """What the blobs of each bucket hold; rows come in order of buckets."""
    now, held = None, []
    for batch in batches:
        for b, size, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if b != now and held:
                yield held
                held = []
                pa.default_memory_pool().release_unused()
            now = b
            held.append(_open(size, blob))
    if held:
        yield held


def _folds(counts: np.ndarray) -> np.ndarray:
    """Four counts (two classes, inside and outside fold 0) as those of SUMS."""
    o0, o1, t0, t1 = counts.T
    return np.stack([o0, o0 + o1, t0, t0 + t1], 1)


MERGED = "kind int, v long, w long, word string, " + ", ".join(f"{n} long" for n in SUMS) + ", " + BLOB


def _merged(bits: int):
    """From sorted blobs of bigrams to words with their continuation counts (kind 0), bigrams above the discount (1), blobs of histories (2)."""

    def batch(kind, n, v=None, w=None, word=None, sums=None, blobs=None):
        none = lambda t: pa.nulls(n, t)
        long = lambda x: none(pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
        cols = [pa.array(np.full(n, kind, np.int32)), long(v), long(w), none(pa.string()) if word is None else pa.array(word, pa.string())]
        cols += [long(None if sums is None else sums[:, k]) for k in range(len(SUMS))]
        cols += [pa.array([b[k] for b in blobs], t) if blobs else none(t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "v", "w", "word", *SUMS, "bucket", "size", "blob"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buckets(batches):
            names: dict[int, str] = {}
            for w, _, _, text in held:
                names.update(zip(np.unique(w).tolist(), text.split("\n"), strict=True))
            (w, v), counts = _summed(tuple(np.concatenate([x[k] for x in held]) for k in (0, 1)), np.concatenate([x[2] for x in held]))
            held.clear()
            sums = _folds(counts)
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            yield batch(0, len(starts), w=w[starts], word=[names[x] for x in w[starts].tolist()], sums=np.add.reduceat((sums > 0).astype(np.int64), starts, axis=0))
            kept = np.maximum(sums[:, 1], sums[:, 3]) > PAIR_DISCOUNT
            yield batch(1, int(kept.sum()), v=v[kept], w=w[kept], sums=sums[kept])
            (first,), seen = _summed((v,), np.concatenate([counts, np.stack([(sums[:, k] + sums[:, k + 2]) > 0 for k in range(2)], 1)], 1))
            seen = _narrow(seen)
            blobs = list(_blobs(first, bits, lambda a, b: (first[a:b], seen[a:b])))
            yield batch(2, len(blobs), blobs=blobs)
            # Nothing of a bucket stays while the next one is read.
            names = w = v = counts = sums = starts = kept = first = seen = blobs = None

    return run


HISTORY = "v long, " + ", ".join(f"n{n} long" for n in SUMS) + ", " + ", ".join(f"d{f} long" for f in FOLDS)


def _histories(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words before others, with their counts and the numbers of distinct words after them; only those that a kept bigram can have."""
    for held in _buckets(batches):
        (v,), seen = _summed((np.concatenate([x[0] for x in held]),), np.concatenate([x[1] for x in held]))
        held.clear()
        sums = np.concatenate([_folds(seen[:, :4]), seen[:, 4:]], 1)
        kept = np.maximum(sums[:, 1], sums[:, 3]) > PAIR_DISCOUNT
        v, sums = v[kept].view(np.int64), sums[kept]
        yield pa.RecordBatch.from_arrays([pa.array(v), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], names=["v", *(f"n{n}" for n in SUMS), *(f"d{f}" for f in FOLDS)])


def _marked(docs: DataFrame, labels: DataFrame, id_col: str, held_out: Column | None) -> DataFrame:
    """Labelled training rows: id, class, hash, part (2 * toxic + fold)."""
    marked = labels.select(F.col(id_col).alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marked = marked.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        marked = marked.where(~held_out)
    marked = marked.withColumn("h", F.xxhash64("label_id"))
    return cut(marked.withColumn("part", (F.col("toxic") * 2 + (F.pmod("h", F.lit(CURVE_SHARE)) == 0).cast("int")).cast("int")).withColumn("key", F.xxhash64(F.col("label_id").cast("string"))))


def _blend(kt, ko, totals, which, back_t, back_o):
    """Interpolated probabilities of both classes from their counts; the backoff weight is that of both together.

    totals: sums of all counts of the level, and of what the discount takes off them.
    """
    total_t, total_o = max(totals[f"t{which}"], 1), max(totals[f"o{which}"], 1)
    weight = (totals[f"low_t{which}"] + totals[f"low_o{which}"]) / (total_t + total_o)
    return np.maximum(kt - DISCOUNT, 0) / total_t + weight * back_t, np.maximum(ko - DISCOUNT, 0) / total_o + weight * back_o


def telling(t: np.ndarray, o: np.ndarray, back_t: np.ndarray, back_o: np.ndarray, totals: dict) -> np.ndarray:
    """Whether counts depart from the split that the probabilities of the backoff let expect."""
    a, b = back_t * max(totals["tall"], 1), back_o * max(totals["oall"], 1)
    n, share = t + o, a / (a + b)
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)), 0.0)
    return 2 * (part(t, share) + part(o, 1 - share)) >= TELLING


def rate(words: pd.DataFrame, stems: pd.DataFrame, totals: dict, which: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Probabilities t and o of words and stems by the counts of a fold, and whether they tell more than their backoff; all that begin with the same first letters must be there.

    totals: by number of letters, 0 for words; 'stems' and 'words' for the pooled sums of the fewest letters and of the kept words.
    """
    t, o = f"t{which}", f"o{which}"
    # Stems, from the fewest letters to the most.
    prob: dict[str, tuple[float, float]] = {}
    tells: list[bool] = []
    stems = stems[(stems[t] + stems[o]) > 0]
    for n in sorted(STEMS):
        level = stems[stems["letters"] == n]
        if not len(level):
            continue
        kt, ko = level[t].to_numpy(float), level[o].to_numpy(float)
        keys = level["text"].tolist()
        parents = [_parent(k, n) for k in keys]
        sums: dict[str, float] = Counter()
        for p, x in zip(parents, kt + ko, strict=True):
            sums[p] += x
        if n == min(STEMS):
            sums[""] = totals["stems"][which]
        within = (kt + ko) / np.array([sums[p] for p in parents])
        back_t, back_o = (np.array([prob.get(p, (1.0, 1.0))[i] for p in parents]) * within for i in (0, 1))
        pt, po = _blend(kt, ko, totals[n], which, back_t, back_o)
        tells += telling(kt, ko, back_t, back_o, totals[n]).tolist()
        prob.update(zip(keys, zip(pt.tolist(), po.tolist(), strict=True), strict=True))
    out = pd.DataFrame([(k, *x) for k, x in prob.items()], columns=["text", "t", "o"]).assign(tells=np.array(tells, bool))
    # Words, by the number of distinct words before them.
    words = words[(words[t] + words[o]) > 0]
    kt, ko = words[t].to_numpy(float), words[o].to_numpy(float)
    parents = [next((s for s in stems_of(w) if s in prob), "") for w in words["text"]]
    sums = Counter()
    for s, x in zip(parents, kt + ko, strict=True):
        sums[s] += x
    # A word without a known stem gets its share of all words.
    sums[""] = max(totals["words"][which], 1)
    within = (kt + ko) / np.array([sums[s] for s in parents])
    back_t, back_o = (np.array([prob.get(s, (1.0, 1.0))[i] for s in parents]) * within for i in (0, 1))
    word_t, word_o = _blend(kt, ko, totals[0], which, back_t, back_o)
    tells = telling(kt, ko, back_t, back_o, totals[0])
    return words[["text"]].assign(t=word_t, o=word_o, tells=tells), out


RATED = "is_word boolean, key long, tells boolean, " + ", ".join(f"p{c}{f} double" for f in FOLDS for c in "to")


def _rated(totals: dict):
    """Words and stems with their probabilities by fold, a partition at a time; null where a fold does not hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if not len(rows):
            return
        words, stems = rows[rows["letters"] == 0], rows[rows["letters"] > 0]
        both = [words[["text"]].drop_duplicates(), stems[["text"]].drop_duplicates()]
        for f in FOLDS:
            for k, one in enumerate(rate(words, stems, totals, f)):
                one = one.rename(columns={"t": f"pt{f}", "o": f"po{f}"})
                both[k] = both[k].merge(one if f == FOLDS[-1] else one.drop(columns="tells"), "left", "text")
        yield both[0].assign(is_word=True, key=hashes(both[0]["text"].tolist()).view(np.int64)).drop(columns="text")[[c.split()[0] for c in RATED.split(", ")]]
        yield both[1].assign(is_word=False, key=stem_keys(both[1]["text"].tolist())).drop(columns="text")[[c.split()[0] for c in RATED.split(", ")]]

    return run


def _paired(totals: dict):
    """Differences of bigrams that tell more than their second word, from the counts of their first word and the probabilities of their second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _differences(b[telling(*(b[c].to_numpy(float) for c in ("tall", "oall", "ptall", "poall")), totals)])

    return run


def _differences(b: pd.DataFrame) -> pd.DataFrame:
    out = {"key": pair_keys(b["v"].to_numpy(np.int64).view(np.uint64), b["w"].to_numpy(np.int64).view(np.uint64))}
    for f in FOLDS:
        nt, no = b[f"nt{f}"].to_numpy(float), b[f"no{f}"].to_numpy(float)
        weight = np.minimum(0.95, PAIR_DISCOUNT * b[f"d{f}"].to_numpy(float) / np.maximum(nt + no, 1))
        one = lambda c, n, back: np.where(n > 0, np.maximum(c - PAIR_DISCOUNT, 0) / np.maximum(n, 1) + weight * back, back)  # noqa: B023, E731
        out[f"x{f}"] = np.log(one(b[f"t{f}"].to_numpy(float), nt, b[f"pt{f}"].to_numpy(float))) - np.log(one(b[f"o{f}"].to_numpy(float), no, b[f"po{f}"].to_numpy(float)))
    return pd.DataFrame(out)


def _parent(stem: str, n: int) -> str:
    """The stem of the next fewer letters."""
    k = STEMS.index(n)
    if k + 1 == len(STEMS):
        return ""
    return stem if stem.endswith("$") and len(stem) <= STEMS[k + 1] else stem[: STEMS[k + 1]]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """held_out: a condition on label_id; such rows are not learnt from. max_toxic, max_ordinary: rows that the curve is fitted on."""
    marked = _marked(docs, labels, id_col, held_out)
    counts = Counter({r["part"]: r["count"] for r in marked.groupBy("part").count().collect()})
    if not counts[0] + counts[1] or not counts[2] + counts[3]:
        return Model()
    ids = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).where("doc_id IS NOT NULL")
    parts = publish(marked, "key", ["part"])
    # A bucket holds the bigrams of about 2 million characters, so that one fits a worker.
    share = counts.total() / max(1, docs.count())
    bits = max(2, int(np.ceil(np.log2(max(1.0, min(1.0, share) * (ids.agg(F.sum(F.length("text"))).first()[0] or 0) / 2e6)))))
    by_bucket = lambda df: df.repartition(2**bits, "bucket").sortWithinPartitions("bucket")
    raw = ids.select(F.xxhash64(F.col("doc_id").cast("string")), "text").mapInArrow(_counted(parts, bits), BLOB)
    merged = cut(by_bucket(raw).mapInArrow(_merged(bits), MERGED))
    history = by_bucket(merged.where("kind = 2").select("bucket", "size", "blob")).mapInArrow(_histories, HISTORY)
    pairs = merged.where("kind = 1").select("v", "w", *SUMS)
    vocabulary = merged.where("kind = 0").select(F.col("w").alias("key"), F.col("word").alias("text"), *SUMS)
    prefix = F.explode(F.array(*(F.struct(F.lit(n).alias("letters"), F.when(F.length("text") >= n, F.substring("text", 1, n)).otherwise(F.concat("text", F.lit("$"))).alias("stem")) for n in STEMS)))
    stems = cut(vocabulary.select(prefix.alias("p"), *SUMS).groupBy(F.col("p.letters").alias("letters"), F.col("p.stem").alias("text")).agg(*(F.count_if(F.col(n) > 0).alias(n) for n in SUMS)))
    often = F.greatest("tall", "oall") > DISCOUNT
    totals: dict = {r["letters"]: r.asDict() for r in stems.groupBy("letters").agg(*_totals()).collect()}
    totals[0] = vocabulary.agg(*_totals()).first().asDict()
    # What the discount takes off altogether in both classes has the difference of its backoff, so it need not be kept for itself.
    # A word of a kept bigram is kept too, whatever its own count: it has the difference of its stem, and the bigram its own.
    paired = pairs.select(F.col("w").alias("key")).distinct()
    words = vocabulary.where(often).unionByName(vocabulary.where(~often).join(paired, "key", "left_semi"))
    kept = cut(words.select(F.lit(0).alias("letters"), "text", *SUMS).unionByName(stems.where(often).select("letters", "text", *SUMS)))
    pooled = [F.sum(F.col(f"t{f}") + F.col(f"o{f}")).alias(f) for f in FOLDS]
    for name, n in (("words", 0), ("stems", min(STEMS))):
        totals[name] = {f: x or 0 for f, x in kept.where(F.col("letters") == n).agg(*pooled).first().asDict().items()}
    first = F.when(F.length("text") >= min(STEMS), F.substring("text", 1, min(STEMS))).otherwise(F.when(F.col("letters") == 0, F.concat("text", F.lit("$"))).otherwise(F.col("text")))
    rated = cut(kept.repartition(first).mapInPandas(_rated(totals), RATED))
    with_history = pairs.join(history, "v").join(rated.where("is_word").drop("is_word").withColumnRenamed("key", "w"), "w")
    singles = rated.where("tells").select("key", *((F.log(f"pt{f}") - F.log(f"po{f}")).alias(f"x{f}") for f in FOLDS))
    table = publish(singles.unionByName(with_history.mapInPandas(_paired(totals[0]), "key long, x0 double, xall double")), "key", ["x0", "xall"])
    # Rows outside fold 0 are scored with the counts of fold 0, and the curve is fitted to that.
    outside = marked.where("part % 2 = 1")
    chosen = outside.where("toxic = 1").orderBy("h", "label_id").limit(max_toxic).unionByName(outside.where("toxic = 0").orderBy("h", "label_id").limit(max_ordinary))
    # At most max_toxic + max_ordinary rows of an id and a number.
    rows = ids.join(F.broadcast(chosen.select("label_id", "toxic")), F.col("doc_id") == F.col("label_id")).select("text", "toxic")

    ratio = min(1.0, max_toxic / max(1, counts[3])) / min(1.0, max_ordinary / max(1, counts[1]))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(table, 0)
        for pdf in batches:
            x = [f for part in _some(pdf["text"].tolist()) for f in own.features_of(part)]
            yield pd.DataFrame(x, columns=["mean", "strong", "peak"]).assign(toxic=pdf["toxic"].to_numpy())

    seen = rows.mapInPandas(features, "mean double, strong double, peak double, toxic int").toPandas()
    if not len(seen):
        return Model()
    x, y = np.array([design(*x) for x in seen[["mean", "strong", "peak"]].to_numpy()]), seen["toxic"].to_numpy(float)
    model = Model(table, 1, logistic(x, y, np.where(y == 1, 1.0, ratio)))
    return replace(model, cut=cut_of(model.on_curve(x), y))


def cut_of(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The score that RECALL of the toxic rows reach, but for which no more than MOST_LOST of the ordinary ones do; 0.5 at most."""
    if not toxic.any() or toxic.all():
        return 0.5
    by_recall = np.quantile(scores[toxic == 1], 1 - RECALL, method="lower")
    by_loss = np.nextafter(np.quantile(scores[toxic == 0], 1 - MOST_LOST, method="higher"), 1)
    return float(min(0.5, max(by_recall, by_loss)))


def _totals() -> list[Column]:
    return [*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in SUMS), *(F.coalesce(F.sum(F.least(F.col(n), F.lit(DISCOUNT))), F.lit(0.0)).alias(f"low_{n}") for n in SUMS)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge, on columns that are scaled to a deviation of one."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    x = x / scale
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta += step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta / scale


def scores(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column, the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in texts:
            yield pd.Series(own.scores(batch.tolist()), dtype="float64")

    return docs.withColumn(name, score(text_or_empty(text_col)))
