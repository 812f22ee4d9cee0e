"""Times the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line.

Both modes of the build and the extract are timed apart, as the baseline gives them: on ROWS fact rows, made by
repeating those of BENCH_SF_DIR under new line and product numbers. All read Parquet and write all
their files. BENCH_LARGE=0 leaves them out; their seconds are not part of the value.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from basketry.__main__ import extract
from basketry.plans import build
from basketry.plans.catalogue import QUERIES
from basketry.sources import adapter

#: Fact rows of the baseline.
ROWS = 2_756_003

HEADLINES = (
    "daily_action_rates", "join_quality", "norm_strings", "price_features", "per_unit", "pid_segment", "qcut_apply", "target_encode", "cumulative_history", "forward_oof_pid", "stratified_cls",
    "outliers_iqr", "duplicate_keys", "intraday_check", "rate_by_dimension", "core_daily", "orders_line", "redundant_pairs", "spearman", "confusion_grid", "roc_auc", "reg_segments",
)


def large(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds of both modes of the build and of the extract on ROWS fact rows."""
    folder = tempfile.mkdtemp(prefix="spark-")
    fact, dim = adapter.fact(spark, sf_dir), adapter.dim(spark, sf_dir)
    n, products = fact.count(), dim.agg(F.max("pid")).first()[0]
    copies = fact.crossJoin(F.broadcast(spark.range(-(-ROWS // n)).withColumnRenamed("id", "copy")))
    # Each copy belongs to other products, so a product has about as many rows as in the baseline.
    shifted = copies.withColumns({"lineID": F.row_number().over(Window.partitionBy("copy").orderBy("lineID")) + F.col("copy") * n, "pid": F.pmod(F.col("pid") + F.col("copy") * 701, F.lit(products)) + 1})
    shifted.where(F.col("lineID") <= ROWS).drop("copy").repartition(32).write.parquet(f"{folder}/fact")
    dim.write.parquet(f"{folder}/dim")
    fact, dim = spark.read.parquet(f"{folder}/fact"), spark.read.parquet(f"{folder}/dim")
    out = {"rows": fact.count()}
    for name, job in (("build_safe_only", lambda: build.run(fact, dim, f"{folder}/build")), ("build_safe_plus_conditional", lambda: build.run(fact, dim, f"{folder}/conditional", "safe_plus_conditional")), ("extract", lambda: extract(fact, dim, f"{folder}/extract"))):
        began = time.perf_counter()
        job()
        out[name] = round(time.perf_counter() - began, 2)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in HEADLINES:
        best = None
        for _ in range(2):  # the second run has its code compiled
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    at_baseline_rows = large(spark, sf_dir) if os.environ.get("BENCH_LARGE", "1") != "0" else {}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "at_baseline_rows": at_baseline_rows, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
