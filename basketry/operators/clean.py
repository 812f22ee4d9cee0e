"""Cleaning, joining and splitting of the two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import numeric, text
from basketry.schema import Config


def enrich_dim(dim: DataFrame) -> DataFrame:
    """All columns that depend on the product alone, made before the join, once for each product."""
    group, content = text.collapsed(text.normalised(F.col("group"))), F.replace(text.normalised(F.col("content")), F.lit("x"), F.lit("X"))
    return dim.withColumns({
        "campaignIndex_norm": text.campaign(F.col("campaignIndex")),
        "category_norm": text.normalised(F.col("category")),
        "pharmForm_norm": text.normalised(F.col("pharmForm")),
        "unit_norm": text.normalised(F.col("unit")),
        "group_clean": group,
        "content_clean": content,
        "group12": text.group_part(group, 1),
        "group34": text.group_part(group, 3),
        "pack": text.pack(content),
    }).withColumns({
        "has_campaign": (F.col("campaignIndex_norm") != "NONE").cast("int"),
        **{c: F.col(f"pack.{c}") for c in ("is_multipack", "pack_n", "pack_size", "pack_total_size")},
    }).drop("pack")


def join_dim(fact: DataFrame, dim: DataFrame, rows: int, config: Config = Config()) -> DataFrame:
    """Fact left join dimension, which is broadcast only if it is small. rows: those of the dimension.

    A broadcast table is built on the driver. Spark's estimate of its size is that of compressed files, which
    says little of the size in memory, so a larger dimension is kept from being broadcast by that estimate.
    """
    size = rows * dim._jdf.schema().defaultSize()
    return fact.join(F.broadcast(dim) if size <= config.broadcast_bytes else dim.hint("merge"), "pid", "left")


def quantity(order: Column, price: Column, revenue: Column) -> Column:
    return F.when(order == 1, F.try_divide(revenue, F.when(price > 0, price)))


def qty_suspicious(order: Column, q: Column) -> Column:
    odd = q.isNull() | (q < 0) | (q != F.rint(q))
    return F.when(order == 1, odd.cast("int")).otherwise(0)


def clean_fact(fact: DataFrame) -> DataFrame:
    price = F.when(F.col("competitorPrice") > 0, F.col("competitorPrice"))
    return fact.withColumns({
        "competitorPrice": price,
        "competitorPrice_missing": price.isNull().cast("int"),
        "quantity": quantity(F.col("order"), F.col("price"), F.col("revenue")),
    }).withColumns({
        "quantity_class": numeric.quantity_class(F.col("quantity")),
        "qty_suspicious": qty_suspicious(F.col("order"), F.col("quantity")),
    })


def split_of(day: Column, config: Config = Config()) -> Column:
    return F.when(day.between(*config.train_days), "train").when(day.between(*config.test_days), "test").when(day.between(*config.validation_days), "validation")


def one_row_each(dim: DataFrame, key: str = "pid") -> DataFrame:
    """dim, whose plan fails on a key that occurs twice, since a join with it would multiply the fact."""
    n = F.count("*").over(Window.partitionBy(key))
    once = F.assert_true(F.col("__n") == 1, F.concat(F.lit(f"{key} occurs more than once: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return dim.withColumn("__n", n).where(once.isNull()).drop("__n")


def prepare(fact: DataFrame, dim: DataFrame, config: Config = Config()) -> DataFrame:
    """The cleaned, joined rows with their split; days outside all splits have none. A product that occurs twice is an error."""
    return join_dim(clean_fact(fact), enrich_dim(one_row_each(dim)), dim.count(), config).withColumn("split", split_of(F.col("day"), config))


def stage2() -> Column:
    """Rows that the quantity stage learns from."""
    return (F.col("order") == 1) & F.col("quantity").isNotNull() & (F.col("qty_suspicious") == 0)


def map_category(df: DataFrame, mapping: DataFrame, source: str, prefix: str) -> DataFrame:
    """Three-way mapping of a category: the mapped group, and flags for missing and for unmapped values.

    mapping: (source, group), one row for each value; small, and joined on the product side.
    """
    key = text.normalised(F.col(source))
    m = mapping.select(text.normalised(F.col(mapping.columns[0])).alias("__key"), F.col(mapping.columns[1]).alias("__group"))
    out = df.join(m, key == F.col("__key"), "left")
    missing = key == "MISSING"
    return out.withColumns({
        f"{prefix}_group": F.when(missing, "MISSING").otherwise(F.coalesce("__group", F.lit("UNMAPPED"))),
        f"{prefix}_missing_flag": missing.cast("int"),
        f"{prefix}_unmapped_flag": (~missing & F.col("__group").isNull()).cast("int"),
    }).drop("__key", "__group")
