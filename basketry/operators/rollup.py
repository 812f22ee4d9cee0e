"""Roll-ups, rates and the extracts for reporting tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import numeric
from basketry.operators.features import clip_and_bin, price_features
from basketry.operators.ordered import place_of_keys, written


def daily_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(
        F.count("*").alias("n_events"), F.avg("click").alias("click_rate"), F.avg("basket").alias("basket_rate"), F.avg("order").alias("order_rate"), F.avg("price").alias("mean_price"), F.sum("revenue").alias("revenue")
    )


def rate_by(df: DataFrame, column: str, target: str = "order") -> DataFrame:
    """dimension, value, mean and number of rows; rows without a value are left out."""
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.avg(target).alias("rate"), F.count("*").alias("n"))
    return g.select(F.lit(column).alias("dimension"), "value", "rate", "n")


def rates_by(df: DataFrame, columns: Sequence[str], target: str = "order") -> DataFrame:
    """rate_by of several columns in one pass: rows are aggregated under (dimension, value)."""
    tags = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(tags.alias("t"), target).where("t.value is not null").groupBy("t.dimension", "t.value").agg(F.avg(target).alias("rate"), F.count("*").alias("n"))


def pivot_rate(df: DataFrame, row: str, column: str, values: Sequence, target: str = "order") -> DataFrame:
    return df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, list(values)).avg(target)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def order_keys(order: Sequence[str]) -> Column:
    """A total order of the columns, null last."""
    return F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"v_{c}"))))


def first_by(column: str, keys: Column) -> Column:
    """The first non-null value of a group in the order of keys: no sort, one aggregate."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), keys))


DAILY_FIRST = ("availability", "adFlag", "campaignIndex_norm", "has_campaign", "competitorPrice_missing", "price_diff_bin", "discount_bin")
STATIC = ("manufacturer", "category_norm", "pharmForm_norm", "genericProduct", "salesIndex", "is_multipack", "pack_n", "pack_size", "rrp")


def with_price_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """The interval bins of price difference and discount that the extracts show."""
    return clip_and_bin(price_features(df), {"price_diff": "price_diff_bin", "price_discount": "discount_bin"}, bins)


def core_daily(df: DataFrame) -> DataFrame:
    """One row for each day and product: counts, rates, median price, first attributes and the segment of the product; the price bins only if df has them.

    One aggregate on (day, pid) replaces separate passes; product columns are the same in all rows of
    a product, so they are taken in the same aggregate.
    """
    firsts = [c for c in DAILY_FIRST if c in df.columns]
    # The keys are made once for a row, before the aggregate.
    days = df.withColumn("__keys", order_keys(firsts)).groupBy("day", "pid").agg(
        F.count("lineID").alias("n_events"), F.sum("click").alias("n_click"), F.sum("basket").alias("n_basket"), F.sum("order").alias("n_order"), F.median("price").alias("price"),
        *(first_by(c, F.col("__keys")).alias(c) for c in firsts), *(F.first(c, ignorenulls=True).alias(c) for c in STATIC),
    )
    # Written, since the segments are made from it and joined to it.
    days = written(days).withColumns({f"{a}_rate": F.col(f"n_{a}") / F.col("n_events") for a in ("click", "basket", "order")})
    totals = days.groupBy("pid").agg(F.sum("n_events").alias("pid_total_events"))
    size = totals.agg(F.count("*").alias("keys"))
    ranked = place_of_keys(totals, "pid_total_events", "pid").join(F.broadcast(size))
    segment = F.when(F.col("rank") <= F.ceil(F.col("keys") * 0.1), "Head").when(F.col("rank") > F.ceil(F.col("keys") * 0.5), "Tail").otherwise("Mid")
    return days.join(ranked.select("pid", "pid_total_events", segment.alias("pid_segment")), "pid")


def order_lines(df: DataFrame, daily: DataFrame) -> DataFrame:
    """Order rows with a plausible whole quantity, its class, and attributes of the day and product."""
    raw = F.try_divide(F.col("revenue"), F.col("price"))
    q, odd = numeric.rounded_quantity(raw)
    lines = df.where("`order` = 1").select("lineID", "day", "pid", "price", "revenue", q.alias("quantity"), odd.alias("qty_suspicious"))
    lines = lines.withColumn("quantity_class", numeric.quantity_class_of_lines(F.col("quantity")))
    attributes = daily.select("day", "pid", "category_norm", "pharmForm_norm", "genericProduct", "pid_segment", "availability", "adFlag", "campaignIndex_norm", "is_multipack", "salesIndex")
    return lines.join(attributes, ["day", "pid"], "left")


def moving_average(daily: DataFrame, column: str, before: int = 3, after: int = 3) -> DataFrame:
    """Over one row for each day."""
    return daily.withColumn(f"{column}_ma", F.avg(column).over(Window.orderBy("day").rowsBetween(-before, after)))


def equal_width_rate(df: DataFrame, column: str, bins: int, target: str = "order") -> DataFrame:
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    held = df.where(F.col(column).isNotNull()).join(F.broadcast(ends))
    place = numeric.equal_width_bin(F.col(column), F.col("__low"), F.col("__high"), bins)
    return held.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(target).alias("rate"))


def top(df: DataFrame, column: str, least: int, k: int) -> DataFrame:
    return rate_by(df, column).where(F.col("n") >= least).orderBy(F.desc("rate"), "value").limit(k)
