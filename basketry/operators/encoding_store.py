"""What the conditional features need to know of earlier rows, as sums that can be added to.

The store holds, for each encoding, sums and counts of the target by (group, block of weeks), and for
each product the counts of its rows, clicks, baskets and orders. Both are sums, so a later run adds a
batch of its own rows and never reads the old fact again. Encodings are read as of a block: a row of
block b gets the mean over all earlier blocks; as of a block behind the last it gets the mean of all.

A batch is a folder of its own, so writing it again replaces it, and a broken run can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.numeric import week_block
from basketry.operators import history
from basketry.operators.history import COUNTERS, ENCODINGS, FIRST_DAY, Encoding

#: Plain means of the training rows; without a training row they are null.
MEANS = (Encoding("group12_order", "group12", "order", None), Encoding("group34_order", "group34", "order", None), Encoding("week_order", "week_block", "order", None))
EVERY = (*MEANS, *ENCODINGS)


def cells(rows: DataFrame, encodings: Sequence[Encoding] = EVERY, first_day: int = FIRST_DAY) -> DataFrame:
    """encoding, grp, block, s and n: sum and count of the target. All encodings in one pass; a null group counts for the mean of all."""
    def one(e: Encoding) -> Column:
        mask = F.lit(True) if e.history is None else F.expr(e.history)
        return F.struct(F.lit(e.name).alias("encoding"), F.col(e.group).cast("string").alias("grp"), F.when(mask, F.col(e.target)).cast("double").alias("v"))

    long = rows.select(week_block(F.col("day"), first_day).alias("block"), F.explode(F.array(*map(one, encodings))).alias("x")).where("x.v is not null")
    return long.groupBy("x.encoding", "x.grp", "block").agg(F.sum("x.v").alias("s"), F.count("*").alias("n"))


def counters(rows: DataFrame, first_day: int = FIRST_DAY) -> DataFrame:
    """pid and the sums that its later rows start from."""
    valid = F.coalesce((F.col("day") >= first_day).cast("int"), F.lit(0))
    return rows.groupBy("pid").agg(*(F.coalesce(F.sum(valid if c is None else valid * F.col(c)), F.lit(0)).cast("long").alias(n) for n, c in COUNTERS.items()))


class EncodingStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, train: DataFrame, every: DataFrame, batch: str, first_day: int = FIRST_DAY) -> None:
        """train: rows that encodings are learnt from; every: all rows that later ones come after. The same batch is replaced."""
        cells(train, first_day=first_day).write.mode("overwrite").parquet(f"{self.folder}/cells/batch={batch}")
        counters(every, first_day).write.mode("overwrite").parquet(f"{self.folder}/counters/batch={batch}")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells").groupBy("encoding", "grp", "block").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    def counters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/counters").groupBy("pid").agg(*(F.sum(n).alias(n) for n in COUNTERS))


def encoded(rows: DataFrame, sums: DataFrame, as_of: Column | None = None, encodings: Sequence[Encoding] = EVERY, blocks: Sequence[int] = (1 << 30,)) -> DataFrame:
    """rows with every encoding as of a block, which must be one of `blocks`; by default all of the store counts.

    A group that is unknown then gets the mean of all groups then, and without any row the cold start.
    """
    at = F.lit(max(blocks)) if as_of is None else as_of
    # Weeks, not rows.
    points = F.array(*(F.lit(int(b)) for b in blocks))
    before = sums.withColumn("at", F.explode(F.filter(points, lambda b: b > F.col("block"))))
    names = [e.name for e in encodings]
    means = before.groupBy("at").pivot("encoding", names).agg(F.try_divide(F.sum("s"), F.sum("n")))
    overall = F.broadcast(means.select(F.col("at").alias("__when"), *(F.col(n).alias(f"__all_{n}") for n in names)))
    out = rows.withColumn("__as_of", at).join(overall, F.col("__as_of") == F.col("__when"), "left")
    for group in dict.fromkeys(e.group for e in encodings):
        own = [e.name for e in encodings if e.group == group]
        found = before.where(F.col("encoding").isin(*own) & F.col("grp").isNotNull()).groupBy(F.col("grp").alias("__grp"), F.col("at").alias("__at")).pivot("encoding", own).agg(F.try_divide(F.sum("s"), F.sum("n")))
        found = found.select("__grp", "__at", *(F.col(n).alias(f"__of_{n}") for n in own))
        out = out.join(found, (F.col(group).cast("string") == F.col("__grp")) & (F.col("__as_of") == F.col("__at")), "left").drop("__grp", "__at")
    for e in encodings:
        out = out.withColumn(e.name, F.coalesce(f"__of_{e.name}", f"__all_{e.name}", F.lit(e.cold_start).cast("double")))
    return out.drop("__as_of", "__when", *(f"__{k}_{n}" for k in ("of", "all") for n in names))


def later_history(rows: DataFrame, store: EncodingStore, first_day: int = FIRST_DAY) -> DataFrame:
    """The running counts of rows that come after all rows of the store: those of the store and of the rows before them."""
    held = store.counters().select(F.col("pid").alias("__pid"), *(F.col(n).alias(f"__held_{n}") for n in COUNTERS))
    own = history.cumulative(rows, first_day=first_day)
    out = own.join(held, F.col("pid").eqNullSafe(F.col("__pid")), "left").withColumns({n: F.col(n) + F.coalesce(f"__held_{n}", F.lit(0)) for n in COUNTERS})
    return out.withColumn("num_pid_order", F.col("order_time")).drop("__pid", *(f"__held_{n}" for n in COUNTERS))
