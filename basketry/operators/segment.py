"""Head, mid and tail keys and concentration of events; keys are ranked in ranges, never in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.ordered import place_of_keys


def _ranked(df: DataFrame, key: str = "pid") -> DataFrame:
    """(key, n, rank, keys, total): keys by falling number of rows, ties by key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    size = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("total"))
    return place_of_keys(counts, "n", key).join(F.broadcast(size))


def _band(head: Column, mid: Column) -> Column:
    return F.when(F.col("rank") <= head, "Head").when(F.col("rank") <= mid, "Mid").otherwise("Tail")


def fit_segments(train: DataFrame, rule: str = "ceil_min1") -> DataFrame:
    """(pid, n_events, pid_segment). rule: 'ceil_min1' (canonical), 'ceil', or 'floor' (positions from the report)."""
    keys = F.col("keys")
    if rule == "floor":
        head, mid = F.floor(keys * 0.1), F.floor(keys * 0.5)
    else:
        head, mid = F.ceil(keys * 0.1), F.ceil(keys * 0.5)
        if rule == "ceil_min1":
            head, mid = F.greatest(F.lit(1), head), F.greatest(F.lit(1), mid)
    return _ranked(train).select("pid", F.col("n").alias("n_events"), _band(head, mid).alias("pid_segment"))


def apply_segments(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Keys that training has not seen are Tail."""
    s = segments.select(F.col("pid").alias("__pid"), "pid_segment")
    return df.join(s, F.col("pid") == F.col("__pid"), "left").withColumn("pid_segment", F.coalesce("pid_segment", F.lit("Tail"))).drop("__pid")


def band_report(df: DataFrame) -> DataFrame:
    """Keys, events, share of events and order rate of each band by floor positions."""
    bands = fit_segments(df, "floor").select(F.col("pid").alias("__pid"), "pid_segment")
    joined = df.join(bands, F.col("pid") == F.col("__pid"))
    total = df.agg(F.count("*").alias("total"))
    g = joined.groupBy("pid_segment").agg(F.count_distinct("pid").alias("n_keys"), F.count("*").alias("n_events"), F.avg("order").alias("order_rate"))
    return g.join(F.broadcast(total)).select("pid_segment", "n_keys", "n_events", (F.col("n_events") / F.col("total")).alias("event_share"), "order_rate")


def concentration(df: DataFrame) -> DataFrame:
    """Shares of events that the top 1 %, the top 10 % and the bottom 50 % of the keys hold."""
    r = _ranked(df)
    top = lambda p: F.sum(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("keys") * p)), F.col("n")).otherwise(0)) / F.max("total")
    bottom = F.sum(F.when(F.col("rank") > F.col("keys") - F.floor(F.col("keys") * 0.5), F.col("n")).otherwise(0)) / F.max("total")
    return r.agg(top(0.01).alias("top_1pct"), top(0.1).alias("top_10pct"), bottom.alias("bottom_50pct"))


def pareto(df: DataFrame) -> DataFrame:
    """Cumulative share of events by rank of the key."""
    r = _ranked(df)
    return r.select("pid", "rank", "n", ((F.col("above") + F.col("n")) / F.col("total")).alias("cum_share"))
