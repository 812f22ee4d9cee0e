"""History of each key and forward encodings that never look ahead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.numeric import week_block
from basketry.operators.ordered import with_ranges

COUNTERS = {"pid_total_events": None, "click_time": "click", "basket_time": "basket", "order_time": "order"}
FIRST_DAY = 26


#: Rows of a key's block, about, if one key had all rows of a day.
BLOCK_ROWS = 500_000


def cumulative(df: DataFrame, strict: bool = False, first_day: int = FIRST_DAY, key: str = "pid", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Counts of earlier rows, clicks, baskets and orders of the same key; one exchange and one sort of the rows for all four.

    By default all rows before in (day, lineID); strict: only rows of earlier days. A row with a null
    day comes before all others, and is counted nowhere.

    Sums are made on two levels, so that a key of many rows is no single task: rows are first summed
    by (key, day, range of lineID), a window adds up the blocks of a key, and a second window runs
    within a block. The sums of what lies before a block enter that window as a row of their own,
    which stands before the block's rows, so the rows need no join.
    """
    names, sources = list(COUNTERS), list(COUNTERS.values())
    valid = F.coalesce((F.col("day") >= first_day).cast("int"), F.lit(0))
    values = {f"__v_{n}": (valid if c is None else valid * F.coalesce(c, F.lit(0))).cast("long") for n, c in zip(names, sources, strict=True)}
    rows = with_ranges(df, "lineID", "__block", ranges=max(1, -(-df.count() // block_rows))).withColumns(values)
    blocks = rows.groupBy(key, "day", "__block").agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names))
    # A row for each block of a key: days times ranges at most.
    of_key = Window.partitionBy(key)
    before = of_key.orderBy("day").rangeBetween(Window.unboundedPreceding, -1) if strict else of_key.orderBy("day", "__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select(key, "day", "__block", F.lit(True).alias("__head"), *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__v_{n}") for n in names))
    within = rows.withColumn("__head", F.lit(False))
    if strict:
        within = within.withColumns({f"__v_{n}": F.lit(0).cast("long") for n in names})
    w = Window.partitionBy(key, "day", "__block").orderBy(F.desc("__head"), "lineID").rowsBetween(Window.unboundedPreceding, -1)
    both = within.unionByName(heads, allowMissingColumns=True)
    out = both.withColumns({n: F.sum(f"__v_{n}").over(w) for n in names}).where("not __head").withColumn("num_pid_order", F.col("order_time"))
    return out.select(*df.columns, *names, "num_pid_order")


@dataclass(frozen=True)
class Encoding:
    """A forward encoding: the mean of `target` by `group` over all earlier blocks; only rows where `history` holds count."""

    name: str
    group: str
    target: str
    cold_start: float
    history: str | None = None


ENCODINGS = (
    Encoding("pid_prob", "pid", "order", 0.5),
    Encoding("availability_likelihood", "availability", "order", 0.5),
    Encoding("day_7_likelihood", "day_7", "order", 0.5),
    Encoding("day_7_qty_mean_oof", "day_7", "quantity", 1.0, "order = 1 AND quantity IS NOT NULL AND qty_suspicious = 0"),
)


def _history(e: Encoding) -> tuple[Column, Column]:
    mask = F.lit(True) if e.history is None else F.expr(e.history)
    value = F.when(mask, F.col(e.target))
    return F.sum(value).cast("double").alias("s"), F.count(value).alias("n")


def forward_encode(train: DataFrame, e: Encoding, block: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """train with the encoding added. Rows are first summed by group and block, so the windows run over these sums only.

    source: the same rows by a shorter plan, such as a written table, for the sums; several encodings
    in a row then make a plan that grows by one join each.
    """
    at = week_block(F.col("day")) if block is None else block
    df = train.withColumn("__block", at)
    cells = (train if source is None else source).withColumn("__block", at).groupBy(F.col(e.group).alias("__group"), F.col("__block").alias("__at")).agg(*_history(e))
    before = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    by_group = cells.where("__group is not null").select("__group", "__at", F.try_divide(F.sum("s").over(before), F.sum("n").over(before)).alias("__mean"))
    # A row for each block: there are as many as weeks.
    blocks = cells.groupBy(F.col("__at").alias("__when")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    earlier = Window.orderBy("__when").rowsBetween(Window.unboundedPreceding, -1)
    overall = blocks.select("__when", F.try_divide(F.sum("s").over(earlier), F.sum("n").over(earlier)).alias("__all"))
    out = df.join(by_group, (F.col(e.group) == F.col("__group")) & (F.col("__block") == F.col("__at")), "left").join(F.broadcast(overall), F.col("__block") == F.col("__when"), "left")
    return out.withColumn(e.name, F.coalesce("__mean", "__all", F.lit(e.cold_start))).drop("__block", "__group", "__at", "__mean", "__when", "__all")


def fold_info(train: DataFrame, e: Encoding) -> DataFrame:
    """Per block: its rows, the rows and groups of its history, and the mean of the history."""
    df = train.withColumn("block", week_block(F.col("day")))
    mask = F.lit(True) if e.history is None else F.expr(e.history)
    value = F.when(mask, F.col(e.target))
    known = F.when(mask & F.col(e.target).isNotNull(), F.col(e.group))
    blocks = df.groupBy("block").agg(F.count("*").alias("n_rows"), F.count_if(mask).alias("h"), F.sum(value).cast("double").alias("s"), F.count(value).alias("n"))
    firsts = df.select(known.alias("g"), "block").where("g is not null").groupBy("g").agg(F.min("block").alias("block")).groupBy("block").agg(F.count("*").alias("new_groups"))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    joined = blocks.join(firsts, "block", "left").na.fill(0, ["new_groups"])
    return joined.select(
        F.lit(e.name).alias("feature"), "block", F.when(F.row_number().over(Window.orderBy("block")) == 1, "cold_start").otherwise("forward").alias("kind"),
        "n_rows", past("h").alias("n_history_rows"), past("new_groups").alias("n_groups"), F.round(F.try_divide(F.sum("s").over(w), F.sum("n").over(w)), 6).alias("history_mean"),
    )
