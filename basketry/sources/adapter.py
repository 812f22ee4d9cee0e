"""The fact and dimension tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_all(events: DataFrame) -> DataFrame:
    """Every event, 'error' events included, which belong to no action."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    price = (800 + u % 400 + e % 37) / 100
    digit = e % 10
    multiple = F.when(digit < 7, 1.0).when(digit == 7, 2.0).when(digit == 8, (1 + e % 9).cast("double")).otherwise(1.5)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select(
        e.cast("long").alias("lineID"),
        (F.floor((seconds - 1704067200) / 28800) + 1).cast("int").alias("day"),
        u.cast("long").alias("pid"),
        F.when((e + u) % 10 < 3, 1).otherwise(0).alias("adFlag"),
        F.when(e % 25 == 0, 4).when(e % 11 == 0, 3).when(e % 7 == 0, 2).otherwise(1).alias("availability"),
        F.when(e % 27 == 0, None).when(e % 101 == 0, 0.0).otherwise((800 + u % 400 + e % 61 - 20) / 100).alias("competitorPrice"),
        (kind == "click").cast("int").alias("click"),
        kind.isin("view", "signup").cast("int").alias("basket"),
        (kind == "purchase").cast("int").alias("order"),
        price.alias("price"),
        F.when(kind == "purchase", price * multiple).otherwise(0.0).alias("revenue"),
    )


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_all(table(spark, sf_dir, "events").where("event_type <> 'error'"))


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    text = size.cast("string")
    return table(spark, sf_dir, "part").select(
        k.cast("long").alias("pid"),
        F.substring_index("p_brand", "#", -1).cast("long").alias("manufacturer"),
        F.when(k % 17 == 0, None).when(k % 13 == 0, "7").otherwise(F.concat(text, F.substring(kind, 1, 3))).alias("group"),
        F.when(k % 6 == 0, text).when(k % 6 == 1, F.concat(text, F.lit("X10"))).when(k % 6 == 2, F.concat(text, F.lit("x2X5"))).when(k % 6 == 3, " 2.5 ").when(k % 6 == 4, "PAAR").alias("content"),
        F.when(k % 5 == 0, " st").otherwise("ML").alias("unit"),
        F.when(k % 14 == 0, None).otherwise(F.concat(F.lower(kind), F.lit(" "))).alias("pharmForm"),
        (size % 10 == 0).cast("int").alias("genericProduct"),
        F.when(k % 4 == 0, 40).when(k % 4 == 1, 44).when(k % 4 == 2, 52).otherwise(53).alias("salesIndex"),
        F.when(k % 31 == 0, None).otherwise(size % 9).cast("int").alias("category"),
        F.when(k % 12 == 0, "A").when(k % 12 == 1, "b ").when(k % 12 == 2, "C").when(k % 12 == 3, "0").alias("campaignIndex"),
        ((1000 + k % 400) / 100).alias("rrp"),
    )
