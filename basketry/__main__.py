"""python -m basketry build|extract --fact PATH --dim PATH --out FOLDER [--mode MODE]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import guards, rollup
from basketry.operators.clean import prepare
from basketry.plans import build
from basketry.sources import delimited, sinks


def extract(fact: DataFrame, dim: DataFrame, folder: str) -> None:
    """Writes the daily and the order extract, as Parquet and as pipe-separated text."""
    keep = lambda df, name: fact.sparkSession.read.parquet(sinks.save_parquet(df, f"{folder}/{name}.parquet"))
    guards.require_valid(guards.unique_key(dim, "pid"), "product table")
    # What several aggregates read again is a written table.
    df = keep(rollup.with_price_bins(keep(prepare(fact, dim), "staging/prepared")), "staging/binned")
    daily = keep(rollup.core_daily(df), "core_daily")
    lines = keep(rollup.order_lines(df, daily), "orders_line")
    sinks.at_once(lambda: sinks.save_csv(daily, f"{folder}/core_daily.csv", sep="|"), lambda: sinks.save_csv(lines, f"{folder}/orders_line.csv", sep="|"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="basketry", description=__doc__)
    p.add_argument("command", choices=("build", "extract"))
    p.add_argument("--fact", required=True)
    p.add_argument("--dim", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--mode", default="safe_only", choices=("safe_only", "safe_plus_conditional"))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("basketry").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    try:
        fact, dim = delimited.read_fact(spark, a.fact), delimited.read_dim(spark, a.dim)
        if a.command == "build":
            print(build.run(fact, dim, a.out, a.mode))
        else:
            extract(fact, dim, a.out)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
