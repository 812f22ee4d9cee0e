"""Exact ranks, running sums and quantiles without a window over all rows.

Values are cut into ranges by approximate percentiles (a sketch of bounded size; the ranges only
decide which task a row goes to, never a result). The sums of each range are a few rows; windows run
over these, and over the rows within a range.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and the most ranges; fewer rows than one range holds are sorted by one task.
RANGE_ROWS, MOST_RANGES = 200_000, 4096


def ranges_for(rows: int) -> int:
    """The number of ranges that so many rows are cut into. It decides where rows are sorted, never a result."""
    return max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the cluster names in spark.checkpoint.dir; a temporary one only on a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='basketry-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that a plan that uses them several times does not compute them several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _place(value: str | Column, edges: str) -> Column:
    """The number of edges below a value: its range."""
    x = F.col(value) if isinstance(value, str) else value
    return F.size(F.filter(F.col(edges), lambda e: e < x))


def with_ranges(df: DataFrame, value: str, name: str = "__range", ranges: int = 64, edges_by: Sequence[str] = ()) -> DataFrame:
    """df with the range of each value, in increasing order of values; equal values share a range.

    edges_by: columns of few values, such as the name of a feature, for each of which ranges are cut apart.
    """
    if ranges <= 1:
        return df.withColumn(name, F.lit(0))
    points = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    # One row of at most `ranges` numbers, for each value of edges_by.
    numbers = F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(value, points, F.lit(10 * ranges)), F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>"))))
    edges = df.groupBy(*(F.col(c).alias(f"__e_{k}") for k, c in enumerate(edges_by))).agg(numbers.alias("__edges"))
    same = F.lit(True)
    for k, c in enumerate(edges_by):
        same = same & F.col(c).eqNullSafe(F.col(f"__e_{k}"))
    return df.join(F.broadcast(edges), same).withColumn(name, _place(value, "__edges")).drop("__edges", *(f"__e_{k}" for k in range(len(edges_by))))


def running(df: DataFrame, value: str, sums: Mapping[str, str], by: Sequence[str] = (), descending: bool = False, then: Sequence[str] = (), ranges: int | None = None, edges_by: Sequence[str] = ()) -> DataFrame:
    """df with new columns (name: column): sums of the columns over the rows before, in the order of the value and then of `then`, within `by`.

    ranges: by the number of rows, unless given; then df is counted, and should be a written table. edges_by: see `with_ranges`.
    """
    ranges = ranges_for(df.count()) if ranges is None else ranges
    order = F.desc if descending else F.asc
    if ranges <= 1:
        whole = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order(value), *(F.asc(c) for c in then)).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *(F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(n) for n, c in sums.items()))
    cut = with_ranges(df, value, ranges=ranges, edges_by=edges_by)
    totals = cut.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    # At most `ranges` rows in each group.
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"__b_{k}") for k, c in enumerate(by)), F.col("__range").alias("__at"), *(F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums))
    same = F.col("__range") == F.col("__at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{k}"))
    within = Window.partitionBy(*by, "__range").orderBy(order(value), *(F.asc(c) for c in then)).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumns({f"__w_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    out = inner.join(offsets, same)
    return out.withColumns({n: F.col(f"__w_{n}") + F.col(f"__o_{n}") for n in sums}).select(*df.columns, *sums)


def order_statistics(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, feature and ends: for each point (a, b, part), the values at the two places around it and how far it lies between them.

    All columns in one pass: values are counted, running counts give the places of each value, and
    only the values at the wanted places are kept. A column without values has no row.
    """
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(*by, "x.feature", "x.v").where("v is not null")
    keys = [*by, "feature"]
    return places(written(long.groupBy(*keys, "v").agg(F.count("*").alias("n"))), keys, points)


def places(counts: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """The same from a written table of counts (keys, v, n); `feature` is among the keys."""
    placed = running(counts, "v", {"before": "n"}, keys, edges_by=["feature"])
    sizes = counts.groupBy(*(F.col(c).alias(f"__s_{k}") for k, c in enumerate(keys))).agg(F.sum("n").alias("size"))
    same = F.lit(True)
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{k}"))
    # Place k (from 0) lies in [before, before + n); each point needs the two places around it.
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(points)))
    at = lambda x: x["p"] * (F.col("size") - 1)
    holds = lambda place: (place >= F.col("before")) & (place < F.col("before") + F.col("n"))
    hits = F.filter(wanted, lambda x: holds(F.floor(at(x))) | holds(F.ceil(at(x))))
    found = placed.join(sizes, same).withColumn("hits", hits).where("size(hits) > 0").select(*keys, "v", "before", "n", "size", F.explode("hits").alias("x"))
    low, high = F.floor(at(F.col("x"))), F.ceil(at(F.col("x")))
    ends = found.groupBy(*keys, "x").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"), F.max("size").alias("size"))
    part = at(F.col("x")) - F.floor(at(F.col("x")))
    # One struct for each point.
    return ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("x.k").alias("k"), "a", "b", part.alias("part")))).alias("ends"))


def between(a: Column, b: Column, part: Column) -> Column:
    return F.when(a == b, a).otherwise((1 - part) * a + part * b)


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, feature and q: an array with the interpolated quantile of each column at each point, exact."""
    found = order_statistics(df, columns, points, by)
    return found.select(*by, "feature", F.transform("ends", lambda x: between(x["a"], x["b"], x["part"])).alias("q"))


def quantile_row(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """One row with an array of quantiles for each column, null for a column without values."""
    q = quantiles(df, columns, points)
    return q.agg(*(F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns))


def place_of_keys(counts: DataFrame, n: str, key: str) -> DataFrame:
    """counts (a row for each key) with `rank` (from 1 by falling n, then by key) and `above` (the sum of n before).

    Keys with equal n may be most of all keys, so their order within n comes from ranges of the key.
    """
    counts = written(counts)
    ranges = ranges_for(counts.count())
    levels = counts.groupBy(F.col(n).alias("__n")).agg(F.count("*").alias("keys_here"))
    level = running(levels.withColumn("sum_here", F.col("__n") * F.col("keys_here")), "__n", {"keys_above": "keys_here", "sum_above": "sum_here"}, descending=True, ranges=ranges)
    within = running(counts.withColumn("__one", F.lit(1).cast("long")), key, {"earlier": "__one"}, [n], ranges=ranges)
    joined = within.join(level, F.col(n) == F.col("__n"))
    return joined.select(*counts.columns, (F.col("keys_above") + F.col("earlier") + 1).alias("rank"), (F.col("sum_above") + F.col("earlier") * F.col(n)).alias("above"))


#: Ranges in which the distinct values of a category are sorted.
CODE_RANGES = 64


def codes_of(values: DataFrame, column: str) -> DataFrame:
    """value and code (from 0, in the order of values) of a frame of distinct values that are not null, of any type.

    Values are sorted in ranges that are written once; the only window without a partition is over the sizes of the ranges.
    """
    parts = written(values.select(F.col(column).alias("value")).repartitionByRange(CODE_RANGES, "value").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # At most CODE_RANGES rows.
    offsets = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy("value"))
    return parts.withColumn("__k", within).join(F.broadcast(offsets), "__part").select("value", (F.col("__k") - 1 + F.col("__before")).cast("long").alias("code"))
