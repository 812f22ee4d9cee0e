"""Audits: each report is one aggregate over the data, unpivoted to rows afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.numeric import equal_width_bin
from basketry.operators.clean import stage2
from basketry.operators.ordered import quantile_row, quantiles


def rows_of(one: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """The columns of a one-row frame as (key, value) rows."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.select(F.expr(f"stack({len(names)}, {pairs}) AS (`{key}`, `{value}`)"))


def missingness(df: DataFrame) -> DataFrame:
    """column, n_missing and percent of the columns that miss something."""
    one = df.agg(F.count("*").alias("__rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = one.select("__rows", F.expr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n_missing)"))
    return long.where("n_missing > 0").select("column_name", "n_missing", F.bround(F.col("n_missing") * 100.0 / F.col("__rows"), 4).alias("pct_missing"))


def outliers(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """Quartiles, fences and the number of values outside them, of each column."""
    quartiles = quantile_row(df, columns, (0.25, 0.5, 0.75)).select(*(F.col(c).alias(f"q_{c}") for c in columns))
    joined, out = df.select(*columns).join(F.broadcast(quartiles)), []
    for c in columns:
        q1, q3 = F.col(f"q_{c}")[0], F.col(f"q_{c}")[2]
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        out.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.max(q1).alias("q1"), F.max(F.col(f"q_{c}")[1]).alias("median"), F.max(q3).alias("q3"), F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("n_outliers")))
    return joined.agg(F.array(*out).alias("r")).select(F.inline("r"))


def describe(df: DataFrame, column: str) -> DataFrame:
    one = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    one = one.join(F.broadcast(quantile_row(df, [column], (0.5, 0.9, 0.99)).select(F.col(column).alias("p"))))
    return one.select("n", "mean", "std", "min", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "max")


def target_distribution(df: DataFrame) -> DataFrame:
    q = F.when(stage2(), F.col("quantity"))
    rows = df.where("split is not null")
    g = rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.avg("order").alias("order_rate"), F.count(q).alias("qty_n"), F.avg(q).alias("qty_mean"), F.max(q).alias("qty_max"))
    medians = quantiles(rows.select("split", q.alias("quantity")), ["quantity"], [0.5], ["split"]).select("split", F.get("q", F.lit(0)).alias("qty_median"))
    return g.join(medians, "split", "left")


def join_quality(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """metric, value: rows, distinct keys, orphans on both sides, and whether the join keeps the rows."""
    f = fact.agg(F.count("*").alias("fact_rows"), F.count_distinct("pid").alias("fact_keys"))
    d = dim.agg(F.count("*").alias("dim_rows"), F.count_distinct("pid").alias("dim_keys"))
    fk, dk = fact.select("pid").distinct(), dim.select("pid").distinct()
    orphans = fk.join(dk, "pid", "left_anti").agg(F.count("*").alias("fact_orphans")).join(dk.join(fk, "pid", "left_anti").agg(F.count("*").alias("dim_orphans")))
    joined = fact.join(dim.select("pid"), "pid", "left").agg(F.count("*").alias("joined_rows"))
    one = f.join(d).join(orphans).join(joined).withColumn("rows_kept", (F.col("joined_rows") == F.col("fact_rows")).cast("long"))
    return rows_of(one, ["fact_rows", "fact_keys", "dim_rows", "dim_keys", "fact_orphans", "dim_orphans", "joined_rows", "rows_kept"], "metric", "value")


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """check_name, n_violations and status of all checks in one pass."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return rows_of(one, list(checks), "check_name", "n_violations").withColumn("status", F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL"))


def integrity_checks() -> dict[str, Column]:
    c = F.col
    return {
        "one_action_per_row": c("click") + c("basket") + c("order") != 1,
        "price_positive": c("price") <= 0,
        "competitor_price_positive": c("competitorPrice") <= 0,
        "no_revenue_without_order": (c("order") == 0) & (c("revenue") != 0),
        "revenue_with_order": (c("order") == 1) & (c("revenue") <= 0),
        "flag_is_binary": ~c("adFlag").isin(0, 1),
    }


def preprocessing_checks() -> dict[str, Column]:
    c = F.col
    texts = ("campaignIndex_norm", "category_norm", "pharmForm_norm", "unit_norm")
    return {
        "competitor_price_cleaned": c("competitorPrice") <= 0,
        **{f"{b}_is_binary": ~c(b).isin(0, 1) for b in ("click", "basket", "order", "adFlag", "competitorPrice_missing", "qty_suspicious")},
        "missing_flag_agrees": c("competitorPrice_missing") != c("competitorPrice").isNull().cast("int"),
        **{f"{t}_not_empty": c(t) == "" for t in texts},
        "quantity_on_orders_only": (c("order") == 0) & c("quantity").isNotNull(),
        "suspicious_on_orders_only": (c("order") == 0) & (c("qty_suspicious") != 0),
    }


def stage2_checks() -> dict[str, Column]:
    return {"order": F.col("order") != 1, "quantity": F.col("quantity").isNull(), "suspicious": F.col("qty_suspicious") != 0}


def assert_clean(df: DataFrame, checks: Mapping[str, Column], context: str) -> None:
    bad = [f"{r['check_name']}: {r['n_violations']}" for r in violations(df, checks).where("n_violations > 0").collect()]
    if bad:
        raise ValueError(f"{context}: {'; '.join(bad)}")


def integrity(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """All integrity checks of both tables: rules of the fact's rows, doubled keys, and events without a product. Idle products are told, but are no failure."""
    rows = {"revenue_not_negative": F.col("revenue") < 0, **integrity_checks()}
    one = fact.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rows.items()))
    surplus = lambda df, key, name: df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(name))
    fk, dk = fact.select("pid").distinct(), dim.select("pid").distinct()
    lone = {"orphan_events": fk.join(dk, "pid", "left_anti"), "idle_products": dk.join(fk, "pid", "left_anti")}
    # Frames of one row.
    for extra in (surplus(fact, "lineID", "line_key_unique"), surplus(dim, "pid", "product_key_unique"), *(df.agg(F.count("*").alias(n)) for n, df in lone.items())):
        one = one.join(F.broadcast(extra))
    told = F.when(F.col("check_name") == "idle_products", "INFO").when(F.col("n_violations") == 0, "PASS").otherwise("FAIL")
    return rows_of(one, one.columns, "check_name", "n_violations").withColumn("status", told)


def leakage(fact: DataFrame, tolerance: float = 0.01, accept: float = 0.95) -> DataFrame:
    """One row: whether revenue agrees with orders, how many quantities (revenue by price) are near whole numbers, their spread, and the verdict."""
    raw = F.try_divide("revenue", "price")
    whole = F.rint(raw)
    rows = fact.select("order", "revenue", F.when((F.col("order") == 1) & (F.col("price") > 0), raw).alias("raw"), whole.alias("whole"))
    near = F.abs(F.col("raw") - F.col("whole")) <= tolerance
    q = rows.withColumn("q", F.when(near, F.col("whole")))
    one = q.agg(
        F.count_if(F.col("order") == 1).alias("n_orders"), F.count_if((F.col("order") != 1) & (F.col("revenue") > 0)).alias("revenue_without_order"), F.count_if((F.col("order") == 1) & (F.col("revenue") <= 0)).alias("order_without_revenue"),
        F.count("raw").alias("n_checked"), F.count("q").alias("n_near"), F.min("q").alias("q_min"), F.avg("q").alias("q_mean"), F.max("q").alias("q_max"),
    )
    one = one.join(F.broadcast(quantile_row(q, ["q"], (0.5,)).select(F.get("q", F.lit(0)).alias("q_median"))))
    share = F.try_divide("n_near", "n_checked")
    return one.withColumn("share_near", share).withColumn("accepted", F.coalesce(share >= accept, F.lit(False)))


def top_quantities(fact: DataFrame, k: int = 10, tolerance: float = 0.01) -> DataFrame:
    """The k most frequent whole quantities with their shares of all."""
    raw = F.try_divide("revenue", "price")
    q = fact.where("`order` = 1 and price > 0").where(F.abs(raw - F.rint(raw)) <= tolerance).groupBy(F.rint(raw).cast("long").alias("quantity")).agg(F.count("*").alias("n_orders"))
    total = F.broadcast(q.agg(F.sum("n_orders").alias("__all")))
    return q.join(total).select("quantity", "n_orders", (F.col("n_orders") / F.col("__all")).alias("share")).orderBy(F.desc("n_orders"), "quantity").limit(k)


def target_summary(df: DataFrame, column: str, by: str) -> DataFrame:
    """Number, shares of 1, above 1 and from 3, mean, range and upper quantiles of a quantity within each group."""
    y = F.col(column)
    rows = df.where(y.isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    g = rows.groupBy(by).agg(F.count("*").alias("n"), share(y == 1).alias("share_eq_1"), share(y > 1).alias("share_gt_1"), share(y >= 3).alias("share_ge_3"), F.avg(y).alias("mean"), F.min(y).alias("min"), F.max(y).alias("max"))
    q = quantiles(rows, [column], (0.5, 0.95, 0.99), [by]).select(F.col(by), *(F.col("q")[k].alias(n) for k, n in enumerate(("median", "p95", "p99"))))
    return g.join(q, by)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows in bins of equal width (right-closed, the lowest value in the first); empty bins have no row."""
    ends = F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))
    at = equal_width_bin(F.col(column), F.col("__lo"), F.col("__hi"), bins)
    return df.select(column).where(F.col(column).isNotNull()).join(ends).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, surplus rows, and rows that share their key."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_surplus"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_members"))


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("is_duplicate", (F.count("*").over(Window.partitionBy(*keys)) > 1).cast("int"))


def intraday(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of (day, pid) groups in which a column takes more than one value."""
    groups = df.groupBy("day", "pid").agg(*(F.count_distinct(c).alias(c) for c in columns))
    one = groups.agg(F.count("*").alias("n_groups"), *(F.count_if(F.col(c) > 1).alias(c) for c in columns), F.count_if(F.greatest(*columns) > 1).alias("any"))
    pairs = ", ".join(f"'{c}', `{c}`" for c in [*columns, "any"])
    return one.select("n_groups", F.expr(f"stack({len(columns) + 1}, {pairs}) AS (column_name, n_violations)")).select("column_name", "n_groups", "n_violations", (F.col("n_violations") / F.col("n_groups")).alias("share"))


def mapping_coverage(df: DataFrame, prefix: str) -> DataFrame:
    """Events and keys whose category is mapped, missing or unmapped."""
    status = F.when(F.col(f"{prefix}_missing_flag") == 1, "missing").when(F.col(f"{prefix}_unmapped_flag") == 1, "unmapped").otherwise("mapped")
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n_events"), F.count_distinct("pid").alias("n_pids"))


def matrix_shapes(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    out = None
    for name, (df, target) in frames.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(target).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out
