"""Row features, fitted bins and encodings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import numeric
from basketry.functions.numeric import ratio
from basketry.operators.ordered import between, codes_of, order_statistics, quantile_row, running, written


def day_cycles(df: DataFrame) -> DataFrame:
    return df.withColumns({f"day_{n}": numeric.cycle(F.col("day"), n) for n in (7, 14, 30)})


def price_features(df: DataFrame) -> DataFrame:
    price, cp, rrp = F.col("price"), F.col("competitorPrice"), F.col("rrp")
    df = df.withColumns({"price_diff": price - cp, "price_discount": ratio(rrp - price, rrp), "competitorPrice_discount": ratio(rrp - cp, rrp)})
    own, other = F.col("price_discount"), F.col("competitorPrice_discount")
    return df.withColumns({
        "price_discount_diff": own - other,
        "is_lower_price": F.when(cp.isNotNull(), (price < cp).cast("double")),
        "is_discount": F.when(rrp > 0, (price < rrp).cast("double")),
        "is_greater_discount": F.when(own.isNotNull() & other.isNotNull(), (own > other).cast("double")),
    })


def per_unit(df: DataFrame) -> DataFrame:
    total = F.when(F.col("pack_total_size") > 0, F.col("pack_total_size"))
    return df.withColumns({f"{c}_per_unit": ratio(F.col(c), total) for c in ("price", "rrp", "competitorPrice")})


def safe_row_features(df: DataFrame) -> DataFrame:
    return per_unit(price_features(day_cycles(df)))


def fit_edges(train: DataFrame, columns=("price_diff", "price_discount"), bins: int = 20) -> DataFrame:
    """One row with an array of edges for each column."""
    points = [k / bins for k in range(bins + 1)]
    return quantile_row(train, columns, points).select(*(numeric.edges_of(F.col(c)).alias(f"{c}_edges") for c in columns))


def apply_edges(df: DataFrame, edges: DataFrame, column: str, name: str, missing: str) -> DataFrame:
    """The edges are one row of at most a few dozen numbers, so they are broadcast."""
    one = F.broadcast(edges.select(F.col(f"{column}_edges").alias("__edges")))
    return df.join(one).withColumn(name, numeric.bin_label(F.col(column), F.col("__edges"), missing)).drop("__edges")


def clip_and_bin(df: DataFrame, columns: Mapping[str, str], bins: int = 10) -> DataFrame:
    """Columns (column: name) clipped to the 1st and 99th percentile, then in equal-frequency bins labelled by their interval.

    One pass gives all that is needed: a quantile of the clipped values lies between the clipped
    values at the same two places.
    """
    points = (0.01, 0.99, *(k / bins for k in range(bins + 1)))
    found = order_statistics(df, list(columns), points)
    at = lambda x: between(x["a"], x["b"], x["part"])
    low, high = at(F.col("ends")[0]), at(F.col("ends")[1])
    edges = F.transform(F.slice("ends", 3, bins + 1), lambda x: between(numeric.clipped(x["a"], low, high), numeric.clipped(x["b"], low, high), x["part"]))
    e = F.col("edges")
    labels = F.transform(F.sequence(F.lit(1), F.size(e)), lambda k: F.format_string("(%.3f, %.3f]", F.element_at(e, k), F.element_at(e, F.least(k + 1, F.size(e)))))
    # A row of a few dozen numbers for each column: they become constants of the plan.
    fits = {r["feature"]: r for r in found.select("feature", low.alias("low"), high.alias("high"), numeric.edges_of(edges).alias("edges")).withColumn("labels", labels).collect()}
    out = df
    for c, name in columns.items():
        label = F.lit(None).cast("string")
        if c in fits:
            fit = fits[c]
            x = numeric.clipped(F.col(c), fit["low"], fit["high"])
            label = F.lit(fit["labels"][-1])
            for edge, text in reversed(list(zip(fit["edges"][1:], fit["labels"], strict=False))):
                label = F.when(F.round(x, 9) <= edge, text).otherwise(label)
            label = F.when(x.isNotNull(), label)
        out = out.withColumn(name, label)
    return out


def fit_frequency(train: DataFrame, column: str) -> DataFrame:
    """(column, frequency): the share of each value among the rows that have one."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).count()
    total = counts.agg(F.sum("count").alias("__total"))
    return counts.join(F.broadcast(total)).select(F.col(column).alias("__key"), (F.col("count") / F.col("__total")).alias("__value"))


def lookup(df: DataFrame, mapping: DataFrame, column: str, name: str, default: Column) -> DataFrame:
    """A value by key from a fitted mapping (__key, __value); null and unseen keys get the default."""
    return df.join(mapping, F.col(column) == F.col("__key"), "left").withColumn(name, F.coalesce("__value", default)).drop("__key", "__value")


def frequency_encode(df: DataFrame, train: DataFrame, column: str, name: str) -> DataFrame:
    return lookup(df, fit_frequency(train, column), column, name, F.lit(0.0))


def fit_means(train: DataFrame, column: str, target: str) -> DataFrame:
    return train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__key")).agg(F.avg(target).alias("__value"))


def target_encode(df: DataFrame, train: DataFrame, column: str, target: str, name: str, default: Column | None = None) -> DataFrame:
    """Group means of the training rows; others get the mean of all training rows, or `default` if there are none."""
    overall = F.broadcast(train.agg(F.avg(target).alias("__overall")))
    fallback = F.col("__overall") if default is None else F.coalesce("__overall", default)
    return lookup(df.join(overall), fit_means(train, column, target), column, name, fallback).drop("__overall")


def ordinal_by_appearance(train: DataFrame, column: str, order: str = "lineID") -> DataFrame:
    """(__key, __value): codes from 0 in the order in which values first appear; places come from a running count, not from one window over all values."""
    first = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__key")).agg(F.min(order).alias("__first"))
    values = written(first.withColumn("__one", F.lit(1).cast("long")))
    return running(values, "__first", {"__place": "__one"}, then=["__key"]).select("__key", F.col("__place").cast("double").alias("__value"))


def ordinal_sorted(train: DataFrame, column: str) -> DataFrame:
    """(__key, __value): codes from 0 in the order of values."""
    values = train.select(column).where(F.col(column).isNotNull()).distinct()
    return codes_of(values, column).select(F.col("value").alias("__key"), F.col("code").cast("double").alias("__value"))


def aligned_category(df: DataFrame, train: DataFrame, column: str, name: str) -> DataFrame:
    """The value if training has it, MISSING for null, __UNSEEN__ otherwise."""
    seen = train.select(F.col(column).alias("__key")).where("__key is not null").distinct()
    value = F.when(F.col(column).isNull(), "MISSING").when(F.col("__key").isNull(), "__UNSEEN__").otherwise(F.col(column).cast("string"))
    return df.join(seen, F.col(column) == F.col("__key"), "left").withColumn(name, value).drop("__key")
