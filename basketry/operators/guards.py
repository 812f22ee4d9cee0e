"""Guards on targets, keys, probabilities and stored figures.

A guard is one aggregate that ends in a column `valid`, so it can be looked at as a report;
`require_valid` turns it into an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_valid(check: DataFrame, context: str) -> None:
    """An error that names the rows of a check that are not valid; for checks of a few rows."""
    bad = check.where(~F.coalesce(F.col("valid"), F.lit(False))).limit(10).collect()
    if bad:
        raise ValueError(f"{context}: {'; '.join(str(r.asDict()) for r in bad)}")


def strict_number(x: Column, kind: str = "double") -> Column:
    """x as a number; null stays null, and any other value that is no number fails the query."""
    y = x.try_cast(kind)
    return F.when(x.isNotNull() & y.isNull(), F.raise_error(F.concat(F.lit("not a number: "), x.cast("string"))).cast(kind)).otherwise(y)


def number_or(x: Column, fill: float, kind: str = "double") -> Column:
    """x as a number, `fill` where it is null or no number."""
    return F.coalesce(x.try_cast(kind), F.lit(fill).cast(kind))


def target_of(df: DataFrame, task: str) -> DataFrame:
    """The first column as `target`: a nullable integer for 'cls', a double for 'reg'."""
    return df.select(F.col(f"`{df.columns[0]}`").try_cast("double").alias("target")).select(F.col("target").cast("long" if task == "cls" else "double").alias("target"))


def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """All columns of doubles rounded, half to even."""
    return df.select(*(F.bround(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema))


def binary_target(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Valid: both 0 and 1 occur, and nothing else."""
    y = F.col(column)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(y.isNull()).alias("n_missing"), F.count_if(y == 0).alias("n_zero"), F.count_if(y == 1).alias("n_one"), F.count_if(~y.isin(0, 1)).alias("n_other")
    )
    return g.withColumn("valid", (F.col("n_missing") + F.col("n_other") == 0) & (F.col("n_zero") > 0) & (F.col("n_one") > 0))


def at_least(df: DataFrame, column: str, least: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Valid: there is no null and nothing below `least`."""
    g = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_missing"), F.count_if(F.col(column) < least).alias("n_below"))
    return g.withColumn("valid", F.col("n_missing") + F.col("n_below") == 0)


def probability_pairs(df: DataFrame, positive: str, negative: str, by: Sequence[str] = (), tolerance: float = 1e-6) -> DataFrame:
    """Valid: both probabilities are there, lie in [0, 1] and sum to one within the tolerance."""
    p, q = F.col(positive), F.col(negative)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(p.isNull() | q.isNull()).alias("n_missing"), F.count_if(~p.between(0, 1) | ~q.between(0, 1)).alias("n_outside"),
        F.count_if(F.abs(p + q - 1) > tolerance).alias("n_off_sum"),
    )
    return g.withColumn("valid", F.col("n_missing") + F.col("n_outside") + F.col("n_off_sum") == 0)


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """Valid: no key is null or occurs twice."""
    groups = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    some = F.col("__k").isNotNull()
    one = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count_if(some).alias("n_keys"), F.coalesce(F.sum(F.when(~some, F.col("__n"))), F.lit(0)).alias("n_missing"), F.count_if(some & (F.col("__n") > 1)).alias("n_double"))
    return one.withColumn("valid", F.col("n_missing") + F.col("n_double") == 0)


def one_match(df: DataFrame, condition: Column) -> DataFrame:
    """Valid: exactly one row meets the condition, as an incumbent in another file must."""
    return df.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("n_matches")).withColumn("valid", F.col("n_matches") == 1)


def pinned(actual: DataFrame, expected: DataFrame, on: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """A row for each metric: its value, the stored one, and whether they agree. Rows that one side lacks are not valid."""
    long = lambda df, name: df.select(*on, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select(*on, "x.metric", f"x.{name}")
    both = long(actual, "actual").join(long(expected, "expected"), [*on, "metric"], "full")
    delta = F.abs(F.col("actual") - F.col("expected"))
    return both.withColumn("valid", F.coalesce(delta <= tolerance, F.lit(False)))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of both frames side by side, row by row of a key that both hold once; rows have no position of their own."""
    return left.join(right, key)
