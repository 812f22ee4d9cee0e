"""Features dealt anew among the rows by keyed permutations, and the importance that this tells.

A place is permuted by a Feistel network over pairs (left, right) of numbers below a and b, where a * b
is the least such product that holds n places; a result outside 0..n-1 is permuted again until it lies
inside. So every row sends its value of every feature straight to the row that gets it, without a
sort or a join for each feature: the places come from one running count, all features of all rows are
dealt in one exchange, and all of them are scored in one pass.

Values travel in runs: a task packs what its rows send to a block of places, one array for each feature,
and the block's task puts the values to their places. So the exchange has a record for a run of values,
not for each value, and nothing is joined: the key of a place travels the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators import metrics
from basketry.operators.models import importances, numbered, with_vector
from basketry.operators.ordered import running, written

#: Arithmetic is modulo this prime, so that products stay within 64 bits; more places than its square are not needed.
PRIME, FACTOR = 2147483647, 2654435761
#: Rounds of the network, and how often a place is permuted at most. Fewer than a of a * b numbers lie outside, so it hardly ever takes three; an error is raised if it were not enough.
ROUNDS, WALK = 4, 12


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(key: int) -> list[int]:
    return [(key * 1_000_003 + 104_729 * (r + 1)) % PRIME for r in range(ROUNDS)]


def _mixed(x: Column, c: Column) -> Column:
    t = (x + c) % PRIME
    square = (t * t) % PRIME
    return (square * F.lit(FACTOR) + c) % PRIME


def permuted(place: Column, n: int, round_keys: Column) -> Column:
    """The place (0..n-1) to which a place goes by an array of round keys."""
    a, b = sides(n)
    keys = F.transform(round_keys, lambda c, r: F.struct(c.alias("c"), (r % 2 == 0).alias("left")))

    def network(x: Column) -> Column:
        start = F.struct(F.floor(x / b).alias("l"), (x % b).alias("r"))
        step = lambda s, k: F.struct(F.when(k["left"], (s["l"] + _mixed(s["r"], k["c"])) % a).otherwise(s["l"]).alias("l"), F.when(k["left"], s["r"]).otherwise((s["r"] + _mixed(s["l"], k["c"])) % b).alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])

    first = network(place.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a place did not come back")))


def places_of(place: np.ndarray, n: int, round_keys: Sequence[int]) -> np.ndarray:
    """The same for many places at once, in numpy."""

    def mixed(x: np.ndarray, c: int) -> np.ndarray:
        t = (x + c) % PRIME
        return (t * t % PRIME * FACTOR + c) % PRIME

    a, b = sides(n)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x // b, x % b
        for r, c in enumerate(round_keys):
            if r % 2 == 0:
                left = (left + mixed(right, c)) % a
            else:
                right = (right + mixed(left, c)) % b
        return left * b + right

    out = network(place.astype(np.int64))
    for _ in range(2, WALK + 1):
        outside = np.flatnonzero(out >= n)
        if not len(outside):
            return out
        out[outside] = network(out[outside])
    if (out >= n).any():
        raise ValueError("a place did not come back")
    return out


def _runs(values: pa.Array, to: np.ndarray, block_rows: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(block, places within it, values) for each block that gets some of the values."""
    order = np.argsort(to, kind="stable")
    places, sent = to[order], values.take(pa.array(order))
    ends = np.flatnonzero(np.diff(places // block_rows)) + 1
    for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(places)], strict=True):
        block = int(places[low]) // block_rows
        yield block, (places[low:high] - block * block_rows).astype("i4"), sent.slice(low, high - low)


#: Places of a block at most, whose values one task puts in order at a time; rows that a task packs at a time.
BLOCK_ROWS, PACKED_ROWS = 16_384, 131_072
#: Blocks of fewer places are made of few rows, so that there are so many of them; tasks that put blocks in order at most.
BLOCKS, LEAST_BLOCK, MOST_TASKS = 64, 1024, 4096


def dealt(df: DataFrame, features: Sequence[str], key: str = "lineID", seed: int = 42, repeats: int = 1, stay: Sequence[str] = (), among: Sequence[str] | None = None) -> DataFrame:
    """key, and for each repeat k and feature f a column `f__k`: the value that the row gets from another. Keys are unique.

    Each feature has a permutation of its own; nulls are dealt like other values.
    stay: columns that each row keeps. among: the list in which the place of a feature chooses its permutation; the features, unless given.
    """
    among = list(features if among is None else among)
    taken = list(dict.fromkeys([key, *stay, *features]))
    rows = written(df.select(*taken).withColumn("__one", F.lit(1).cast("long")))
    n = rows.count()
    placed = running(rows, key, {"__place": "__one"}).select("__place", *taken)
    # A column of the result: its source, its name and the key of its permutation; what stays has none.
    made = [(c, c, None) for c in dict.fromkeys([key, *stay])]
    made += [(f, f"{f}__{k}", seed * 1000 + k * len(among) + among.index(f)) for k in range(repeats) for f in features]
    kinds = {f.name: f.dataType for f in df.schema}
    texts = {c for c in taken if kinds[c].simpleString() == "string"}
    longs = {c for c in taken if kinds[c].simpleString() in ("bigint", "int", "smallint", "tinyint")}
    block_rows, packed_rows = min(BLOCK_ROWS, max(LEAST_BLOCK, -(-n // BLOCKS))), PACKED_ROWS
    columns = ("d", "i", "s")
    kind_of = {c: "s" if c in texts else "i" if c in longs else "d" for c in taken}
    arrow = {"d": pa.float64(), "i": pa.int64(), "s": pa.string()}

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            place = table.column("__place").to_numpy()
            for j, (source, _, seeded) in enumerate(made):
                kind = kind_of[source]
                values = table.column(source).combine_chunks().cast(arrow[kind])
                to = place if seeded is None else places_of(place, n, round_keys(seeded))
                found = list(_runs(values, to, block_rows))
                ends = pa.array(np.cumsum([0, *(len(p) for _, p, _ in found)]).astype("i4"))
                lists = {c: pa.nulls(len(found), pa.list_(arrow[c])) for c in columns}
                lists[kind] = pa.ListArray.from_arrays(ends, pa.concat_arrays([v for _, _, v in found]))
                at = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p for _, p, _ in found])))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in found], pa.int64()), pa.array([j] * len(found), pa.int32()), at, *(lists[c] for c in columns)], names=["block", "j", "at", *columns])

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= packed_rows:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    def put(table: pa.Table) -> pa.Table:
        out = []
        for j, (source, _, _) in enumerate(made):
            mine = table.filter(pc.equal(table.column("j"), j))
            flat = lambda c: pa.concat_arrays([x.flatten() for x in mine.column(c).chunks])  # noqa: E731, B023
            order = np.argsort(flat("at").to_numpy())
            out.append(flat(kind_of[source]).take(pa.array(order)))
        return pa.table(out, names=[name for _, name, _ in made])

    wide = ", ".join(f"`{name}` {'string' if kind_of[source] == 's' else 'bigint' if kind_of[source] == 'i' else 'double'}" for source, name, _ in made)
    runs = placed.mapInArrow(packed, "block long, j int, at array<int>, d array<double>, i array<long>, s array<string>")
    # The number is given, so that blocks, of little size before what follows multiplies their rows, are not put together into a few tasks.
    got = runs.repartition(min(MOST_TASKS, -(-n // block_rows) or 1), "block").groupBy("block").applyInArrow(put, wide)
    return got.select(*(F.col(name).cast(kinds[source]).alias(name) for source, name, _ in made))


def used_by(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that the model's trees split by, or that have a coefficient; all, if that cannot be told. No other feature can change a score."""
    last = model.stages[-1]
    total = float(last.featureImportances.toArray().sum() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray()).sum())
    # A row for each feature.
    found = {r["feature"]: r["importance"] for r in importances(model, df, features).collect()}
    return [f for f in features if found[f] > 0] if math.isclose(sum(found.values()), total, rel_tol=1e-9) else list(features)


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str = "order", seed: int = 42, key: str = "lineID", repeats: int = 3) -> DataFrame:
    """feature, auc_loss (the mean over the repeats of what the area under the curve loses when the feature is dealt anew) and its standard deviation.

    Features that the model does not use lose nothing, whatever they are dealt; only the others are dealt and scored.
    Each feature is made a number once for a row, before the deal; a row's vectors are assembled once for each repeat. So a variant
    of a row costs an exchange of places in its vector and its score. The stages must treat each feature by itself, as those of `models.preparation` do.
    """
    used = used_by(model, df, features)
    rows, number, (*assembly, last) = numbered(model, df, features)
    rows = rows.select(key, target, *(F.col(c).alias(f) for f, c in number.items()))
    both = dealt(rows, used, key, seed, repeats, stay=[target, *features], among=features)
    # The vector of a row, and for each repeat the one that has every feature dealt anew.
    both, places = with_vector(assembly, both, {f: F.col(f).alias(c) for f, c in number.items()}, "__own")
    for k in range(repeats):
        both, _ = with_vector(assembly, both, {f: F.col(f"{f}__{k}" if f in used else f).alias(c) for f, c in number.items()}, f"__{k}")
    rows = both.select(target, F.col("__own").alias("own"), F.array(*(f"__{k}" for k in range(repeats))).alias("anew"))
    variants = [("", 0, 0, 0), *((f, k, *places[f]) for k in range(repeats) for f in used)]
    v = F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(one, ("feature", "repeat", "at", "n"), strict=True))) for one in variants)))
    at, n, own = F.col("at"), F.col("n"), F.col("own")
    # Arrays, since a plan that has columns for all features is too long to be compiled to machine code.
    vector = F.concat(F.slice(own, F.lit(1), at), F.slice(F.get("anew", F.col("repeat")), at + 1, n), F.slice(own, at + n + 1, F.size(own)))
    each = rows.select("*", v.alias("v")).select(target, "own", "anew", "v.*").select("feature", "repeat", target, array_to_vector(vector).alias("features"))
    scored = last.transform(each).select("feature", "repeat", F.col(target).cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))
    areas = written(metrics.roc_auc(scored, ["feature", "repeat"]))
    base = areas.where("feature = ''").select(F.col("roc_auc").alias("__base"))
    loss = F.col("__base") - F.col("roc_auc")
    out = areas.where("feature <> ''").join(F.broadcast(base)).groupBy("feature").agg(F.avg(loss).alias("auc_loss"), F.stddev_pop(loss).alias("auc_loss_std"))
    rest = df.sparkSession.createDataFrame([(f,) for f in features if f not in used], "feature string")
    none = F.col("__base") - F.col("__base")
    return out.unionByName(rest.join(F.broadcast(base)).select("feature", none.alias("auc_loss"), none.alias("auc_loss_std")))
