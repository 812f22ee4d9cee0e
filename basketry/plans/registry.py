"""The registry of named queries: a Spark plan and, where SQL can express it, an oracle over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.plans.oracle_base import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, rounded: str = "", digits: int = 8):
    """Registers a function (spark, sf_dir) under its name. rounded: columns that both sides round, since sums of doubles depend on their order."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), digits) for c in rounded.split()}) if rounded else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, views, rounded, digits)
        return f

    return register
