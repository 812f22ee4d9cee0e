"""Connected components of a link table, by alternating stars; every step is a bounded aggregate and join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join has plain exchanges and Spark can split a node that most edges share.
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "node"))
    return both.join(least, F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"))
    joined = down.join(least, F.col("u") == F.col("node"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v); root is the least node of the component.

    The number of rounds grows with the logarithm of the largest component; if `rounds` were not
    enough, an error is raised instead of an incomplete result. Each round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    edges = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        edges = cut(_small_star(_large_star(edges)))
        # A star forest no longer changes; its edges sum up to the same number.
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state
    raise RuntimeError("components did not settle")
