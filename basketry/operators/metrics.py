"""Exact classification and regression metrics from aggregates over distinct scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.ordered import quantiles, running, written

GRID = tuple(k / 100 for k in range(5, 81))
EPS = 1e-15


def from_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics that are zero where they are undefined."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return {
        "accuracy": zero(F.try_divide(tp + tn, tp + tn + fp + fn)),
        "precision": precision,
        "recall": recall,
        "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
        "mcc": zero(F.try_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))),
    }


def _counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by, "score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("q"))


def threshold_grid(scored: DataFrame, grid: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and metrics at each threshold, a score at the threshold being positive.

    Rows are counted once under the number of thresholds that they reach; sums over these counts give
    every threshold, so the rows are read once whatever the size of the grid.
    """
    reached = F.size(F.filter(F.array(*(F.lit(t) for t in grid)), lambda t: t <= F.col("score")))
    hist = scored.groupBy(*by, reached.alias("k")).agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("q"))
    steps = scored.sparkSession.createDataFrame([(i, t) for i, t in enumerate(grid)], "i int, threshold double")
    # One row for each number of thresholds reached: at most len(grid) + 1 in each group.
    hit = F.col("k") > F.col("i")
    sums = {"tp": F.when(hit, F.col("p")), "fp": F.when(hit, F.col("q")), "fn": F.when(~hit, F.col("p")), "tn": F.when(~hit, F.col("q"))}
    g = hist.crossJoin(F.broadcast(steps)).groupBy(*by, "threshold").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
    return g.withColumns(from_counts(*(F.col(n) for n in ("tp", "fp", "fn", "tn"))))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    g = scored.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    return g.withColumn("threshold", F.lit(threshold)).withColumns(from_counts(*(F.col(n) for n in ("tp", "fp", "fn", "tn"))))


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve with ties, by counting pairs over distinct scores."""
    c = running(written(_counts(scored, by)), "score", {"below": "q"}, by)
    return c.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("roc_auc"))


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores, from the highest, of precision times the step in recall."""
    c = running(written(_counts(scored, by)), "score", {"p_above": "p", "q_above": "q"}, by, descending=True)
    c = c.withColumn("tp", F.col("p_above") + F.col("p")).withColumn("n", F.col("tp") + F.col("q_above") + F.col("q"))
    return c.groupBy(*by).agg(F.try_divide(F.sum(F.col("tp") / F.col("n") * F.col("p")), F.sum("p")).alias("average_precision"))


def screening_metrics(scored: DataFrame, by: Sequence[str], threshold: float = 0.5, digits: int = 4) -> DataFrame:
    """Accuracy, F1 and MCC at a threshold, both areas and the log loss of each group, rounded."""
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    at = scored.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    m = from_counts(*(F.col(n) for n in ("tp", "fp", "fn", "tn")))
    at = at.select(*by, *(m[n].alias(n) for n in ("accuracy", "f1", "mcc")))
    for part in (roc_auc(scored, by), average_precision(scored, by), log_loss(scored, by)):
        at = at.join(part, list(by))
    return at.select(*by, *(F.round(c, digits).alias(c) for c in at.columns if c not in by))


def with_predictions(scored: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """scored with the class at the default threshold and at the model's own. thresholds: a row of model and threshold for each model."""
    own = F.broadcast(thresholds.select("model", F.col("threshold").alias("__t")))
    return scored.join(own, "model", "left").withColumn("pred_default", (F.col("score") >= default).cast("int")).withColumn("pred_best", (F.col("score") >= F.col("__t")).cast("int")).drop("__t")


def log_loss(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("score")))
    return scored.groupBy(*by).agg(F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("log_loss"))


def regression(df: DataFrame, by: Sequence[str] = (), unit: str = "percent") -> DataFrame:
    """n, mse, rmse, mae, median error, bias, r2 and mape of (y, prediction). unit: of mape, percent or fraction."""
    e, y = F.col("prediction") - F.col("y"), F.col("y")
    scale = 100.0 if unit == "percent" else 1.0
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("*"))).alias("r2"), (F.avg(F.abs(F.try_divide(e, y))) * scale).alias("mape"),
    )
    medians = quantiles(df.select(*by, F.abs(e).alias("error")), ["error"], [0.5], by)
    medians = medians.select(*(F.col(c).alias(f"__m_{k}") for k, c in enumerate(by)), F.get("q", F.lit(0)).alias("median_ae"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__m_{k}"))
    return g.join(medians, same, "left").select(*g.columns, "median_ae", F.sqrt("mse").alias("rmse"))


SEGMENTS: Mapping[str, str] = {"all": "y IS NOT NULL", "eq_1": "y = 1", "gt_1": "y > 1", "ge_3": "y >= 3"}


def regression_segments(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metrics of each overlapping segment of the target."""
    tags = F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in SEGMENTS.items())))
    return regression(df.withColumn("segment", F.explode(tags)), [*by, "segment"])


def diagnostics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p = F.col("prediction")
    marks = {"below_0": p < 0, "below_1": p < 1, "above_10": p > 10, "above_30": p > 30}
    counts = [x for n, c in marks.items() for x in (F.count_if(c).alias(f"n_{n}"), (F.count_if(c) / F.count("*")).alias(f"share_{n}"))]
    return df.groupBy(*by).agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), *counts)


def delta_label(delta: Column, higher_is_better: bool, tolerance: float = 1e-12) -> Column:
    d = delta if higher_is_better else -delta
    return F.when(d > tolerance, "improved").when(d < -tolerance, "worsened").otherwise("no_change")


def clip_effect(df: DataFrame, low: float = 1.0) -> DataFrame:
    """Errors of each model before and after predictions are raised to `low`."""
    both = df.select("model", "y", F.explode(F.array(F.struct(F.lit("raw").alias("k"), F.col("prediction").alias("p")), F.struct(F.lit("clipped").alias("k"), F.greatest("prediction", F.lit(low)).alias("p")))).alias("v"))
    m = regression(both.select("model", "y", F.col("v.k").alias("k"), F.col("v.p").alias("prediction")), ["model", "k"])
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    g = m.groupBy("model").agg(*(at(c, k).alias(f"{c}_{k}") for c in ("mae", "rmse") for k in ("raw", "clipped")))
    for c in ("mae", "rmse"):
        g = g.withColumn(f"{c}_delta", F.col(f"{c}_clipped") - F.col(f"{c}_raw")).withColumn(f"{c}_effect", delta_label(F.col(f"{c}_delta"), False))
    return g
