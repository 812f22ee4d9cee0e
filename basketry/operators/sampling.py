"""Exact, repeatable samples by an integer hash of the line id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.clean import stage2
from basketry.operators.ordered import written


PRIME = 2147483647
#: Ranges of the hash in which the rows of a stratum are counted.
RANGES = 1024


def hash_order(key: str = "lineID", seed: int = 42) -> Column:
    # The key is reduced first, so that the product stays within 64 bits for every key.
    return (F.col(key) % F.lit(PRIME) * F.lit(2654435761) + F.lit(seed)) % F.lit(PRIME)


def stratum_size(n: Column, fraction: float) -> Column:
    """All of one or two rows; else the fraction, rounded half to even, at least one."""
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(1), F.rint(n * fraction).cast("long")))


def first_of_each(df: DataFrame, strata: Sequence[str], size: Column, key: str = "lineID", seed: int = 42, sizes: DataFrame | None = None) -> DataFrame:
    """The first rows of each stratum in hash order, exactly `size` of them, without a sort of the rows.

    Rows are counted by stratum and range of the hash; only the range in which the last row of a
    stratum lies is ranked, by its keys alone. The rows themselves are filtered by that last key.
    size: over `n`, the number of rows of the stratum, or over the columns of `sizes`, one row a stratum.
    """
    h = hash_order(key, seed)
    narrow = written(df.select(*strata, h.alias("__h"), F.col(key).alias("__k"), F.floor(h / (PRIME / RANGES)).alias("__range")))
    cells = narrow.groupBy(*strata, "__range").agg(F.count("*").alias("__here"))
    w = Window.partitionBy(*strata)
    cells = cells.withColumns({"n": F.sum("__here").over(w), "__before": F.coalesce(F.sum("__here").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    if sizes is not None:
        cells = _joined(cells, sizes, strata)
    last = cells.withColumn("__left", size - F.col("__before")).where("__left between 1 and __here").select(*strata, F.col("__range").alias("__at"), "__left")
    ranked = _joined(narrow, last, strata).where("__range = __at").withColumn("__r", F.row_number().over(w.orderBy("__h", "__k")))
    ends = ranked.where(F.col("__r") == F.col("__left")).select(*strata, F.struct("__h", "__k").alias("__end"))
    return _joined(df, ends, strata).where(F.struct(h.alias("__h"), F.col(key).alias("__k")) <= F.col("__end")).select(*df.columns)


def _joined(df: DataFrame, other: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Inner join on strata, null being a stratum; the columns of the strata come from df."""
    renamed = other.select(*(F.col(c).alias(f"__s_{k}") for k, c in enumerate(strata)), *(c for c in other.columns if c not in strata))
    same = F.lit(True)
    for k, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{k}"))
    return df.join(renamed, same).drop(*(f"__s_{k}" for k in range(len(strata))))


def stratified(df: DataFrame, strata: Sequence[str], fraction: float, key: str = "lineID", seed: int = 42) -> DataFrame:
    """Exactly stratum_size rows of each stratum."""
    return first_of_each(df, strata, stratum_size(F.col("n"), fraction), key, seed)


def sample_cls(train: DataFrame, fraction: float = 0.3) -> DataFrame:
    return stratified(train, ["week_block", "order", "pid_segment"], fraction)


def sample_reg(train: DataFrame, fraction: float = 0.3) -> DataFrame:
    return stratified(train.where(stage2()), ["week_block", "quantity_class", "pid_segment"], fraction)


def uniform(df: DataFrame, rows: int, key: str = "lineID", seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(rows)


def class_stratified(df: DataFrame, target: str, rows: int, key: str = "lineID", seed: int = 42) -> DataFrame:
    """Exactly `rows` rows (all, if fewer) with the class shares of df, by largest remainders."""
    classes = df.groupBy(target).agg(F.count("*").alias("__n"))
    total = classes.agg(F.sum("__n").alias("__total"))
    want = classes.join(F.broadcast(total)).withColumn("__want", F.col("__n") * F.least(F.lit(rows), F.col("__total")) / F.col("__total"))
    want = want.withColumn("__floor", F.floor("__want"))
    # One row for each class.
    every = Window.partitionBy(F.lit(1))
    want = want.withColumn("__left", F.least(F.lit(rows), F.col("__total")) - F.sum("__floor").over(every)).withColumn("__place", F.row_number().over(every.orderBy(F.desc(F.col("__want") - F.col("__floor")), target)))
    want = want.select(target, (F.col("__floor") + (F.col("__place") <= F.col("__left")).cast("int")).alias("__k"))
    return first_of_each(df, [target], F.col("__k"), key, seed, want)


def shares(df: DataFrame, column: str, with_null: bool = True) -> DataFrame:
    """(value, share) of each value as text; nulls are a value of their own or left out."""
    rows = df if with_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).count()
    total = counts.agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total)).select("value", (F.col("count") / F.col("total")).alias("share"))


def compare(population: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, pop_frac, sample_frac and abs_diff, rounded half to even."""
    out = None
    for c in columns:
        p, s = shares(population, c).toDF("value", "p"), shares(sample, c).toDF("sv", "s")
        a, b = F.coalesce("p", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
        one = p.join(s, F.col("value").eqNullSafe(F.col("sv")), "full").select(
            F.lit(c).alias("feature"), F.coalesce("value", "sv").alias("value"), F.bround(a, 6).alias("pop_frac"), F.bround(b, 6).alias("sample_frac"), F.bround(F.abs(a - b), 6).alias("abs_diff")
        )
        out = one if out is None else out.unionByName(one)
    return out
