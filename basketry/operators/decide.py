"""Selection rules over metric tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR_PRECISION, FLOOR_RECALL = 0.34, 0.70


def quality_order(distance: bool = True) -> list[Column]:
    """F1, MCC, precision and recall from the highest; then nearness to one half, or the threshold; then the model."""
    last = F.abs(F.col("threshold") - 0.5).asc() if distance else F.col("threshold").asc()
    return [F.desc("f1"), F.desc("mcc"), F.desc("precision"), F.desc("recall"), last, F.asc("model")]


def best_per(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Over one row for each candidate."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def best_threshold(grid: DataFrame, default: float = 0.5, distance: bool = True) -> DataFrame:
    """The best row of each model whose precision has not collapsed against the row at the default threshold.

    Collapsed: less than half of the default's precision, with more recall. If all have, the best row.
    """
    at = grid.where(F.abs(F.col("threshold") - default) < 1e-9).select("model", F.col("precision").alias("__p"), F.col("recall").alias("__r0"))
    held = grid.join(at, "model", "left")
    collapsed = F.coalesce((F.col("precision") < 0.5 * F.col("__p")) & (F.col("recall") > F.col("__r0")), F.lit(False))
    return best_per(held.withColumn("collapsed", collapsed), ["model"], [F.asc("collapsed"), *quality_order(distance)]).drop("__p", "__r0")


def best_above_floors(grid: DataFrame, precision: float = FLOOR_PRECISION, recall: float = FLOOR_RECALL) -> DataFrame:
    """The best row of each model among those above both floors; without any, the best row."""
    meets = (F.col("precision") >= precision) & (F.col("recall") >= recall)
    return best_per(grid.withColumn("meets_floors", meets), ["model"], [F.desc("meets_floors"), *quality_order(False)])


def gate(df: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """passed, and the names of the checks that failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c) >= v, F.lit(False)), F.lit(c)) for c, v in floors.items())))
    return df.withColumn("failed_checks", F.array_join(failed, ",")).withColumn("passed", F.col("failed_checks") == "")


def rank_candidates(df: DataFrame) -> DataFrame:
    """Ranks of regression candidates by error, over all and within models and baselines."""
    of = lambda c, *by: F.rank().over(Window.partitionBy(*by).orderBy(c) if by else Window.orderBy(c)).cast("long")
    return df.withColumns({"mae_rank_all": of("mae"), "rmse_rank_all": of("rmse"), "mae_rank_kind": of("mae", "kind"), "rmse_rank_kind": of("rmse", "kind")})


def stability(test: DataFrame, validation: DataFrame, metrics: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """Metrics of a model on both splits, their differences, and whether all stay within the tolerance."""
    t, v = test.select("model", *(F.col(c).alias(f"test_{c}") for c in metrics)), validation.select("model", *(F.col(c).alias(f"val_{c}") for c in metrics))
    out = t.join(v, "model").withColumns({f"delta_{c}": F.col(f"val_{c}") - F.col(f"test_{c}") for c in metrics})
    stable = F.lit(True)
    for c in metrics:
        stable = stable & (F.abs(f"delta_{c}") < tolerance)
    return out.withColumn("stable", stable)


def against_baseline(df: DataFrame, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Differences of each model from one row, the baseline's."""
    base = F.broadcast(df.where(F.col("model") == baseline).select(*(F.col(c).alias(f"__{c}") for c in metrics)))
    return df.join(base).withColumns({f"delta_{c}": F.col(c) - F.col(f"__{c}") for c in metrics}).drop(*(f"__{c}" for c in metrics))


def verdict(delta: Column, tolerance: float = 0.002) -> Column:
    return F.when(delta < -tolerance, "worse").when(delta > tolerance, "better").otherwise("close")


def ablation_decision(df: DataFrame, least_test: float = 0.002, least_validation: float = 0.0) -> DataFrame:
    """Variants whose gain on test reaches a margin and that do not lose on validation; the best of them is chosen."""
    ok = (F.col("delta_test") >= least_test) & (F.col("delta_validation") >= least_validation)
    out = df.withColumn("accepted", ok)
    best = F.row_number().over(Window.orderBy(F.desc("accepted"), F.desc("delta_test"), "variant")) == 1
    return out.withColumn("chosen", F.col("accepted") & best)


def challenger_threshold(grid: DataFrame, precision: float = FLOOR_PRECISION, recall: float = FLOOR_RECALL, margin: float = 0.03, default: float = 0.5) -> DataFrame:
    """best_above_floors, and whether its precision collapsed.

    Collapsed: precision is below its floor, or a better F1 or MCC than at the default threshold was
    bought with more recall and less precision, both by more than the margin.
    """
    names = ("f1", "mcc", "precision", "recall")
    at = grid.where(F.abs(F.col("threshold") - default) < 1e-9).select("model", *(F.col(c).alias(f"__{c}") for c in names))
    c = F.col
    bought = ((c("f1") > c("__f1")) | (c("mcc") > c("__mcc"))) & (c("recall") > c("__recall") + margin) & (c("precision") < c("__precision") - margin)
    out = best_above_floors(grid, precision, recall).join(at, "model", "left")
    return out.withColumn("precision_collapse", (c("precision") < precision) | F.coalesce(bought, F.lit(False))).drop(*(f"__{n}" for n in names))


def replacement(candidates: DataFrame, incumbent: DataFrame, *, precision: float = 0.36, recall: float = FLOOR_RECALL, auc_slack: float = 0.002, clear_gain: float = 0.003, most_loss: float = 0.01) -> DataFrame:
    """Whether candidates replace the incumbent, and the checks that failed; incumbent: one row of f1, mcc, auc and logloss.

    F1 and MCC must be higher. The area may be lower by `auc_slack` if F1 and MCC both gain `clear_gain`.
    The log loss may be higher by `most_loss`; precision and recall have floors, and precision must not have collapsed.
    """
    names, c = ("f1", "mcc", "auc", "logloss"), F.col
    df = candidates.join(F.broadcast(incumbent.select(*(F.col(n).alias(f"__{n}") for n in names)))).withColumns({f"delta_{n}": F.col(n) - F.col(f"__{n}") for n in names})
    checks = {
        "f1_better": c("delta_f1") > 0,
        "mcc_better": c("delta_mcc") > 0,
        "auc": (c("delta_auc") >= 0) | ((c("delta_auc") >= -auc_slack) & (c("delta_f1") >= clear_gain) & (c("delta_mcc") >= clear_gain)),
        "logloss": c("delta_logloss") <= most_loss,
        "precision": c("precision") >= precision,
        "recall": c("recall") >= recall,
        "no_collapse": ~c("precision_collapse"),
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    out = df.withColumn("failed_checks", F.array_join(failed, ","))
    return out.withColumn("replaces", c("failed_checks") == "").withColumn("critical_logloss", c("delta_logloss") > most_loss).drop(*(f"__{n}" for n in names))


def recommend(errors: DataFrame, baseline: str) -> DataFrame:
    """One row: the model to use for quantities, by its differences from a constant baseline.

    errors: model, kind ('model' or 'baseline'), mae, rmse. A model is recommended if its error is
    hardly higher and the squared error clearly lower. worth_a_forest: the best squared error gains so
    much that a further, slower model is worth training.
    """
    own = F.col("kind") == "model"
    least = lambda m: F.min(F.when(own, F.struct(m, "model")))
    base = lambda m: F.max(F.when(F.col("model") == baseline, F.col(m)))
    one = errors.agg(least("mae").alias("a"), least("rmse").alias("r"), base("mae").alias("base_mae"), base("rmse").alias("base_rmse"))
    one = one.select(F.col("a.model").alias("best_by_mae"), F.col("r.model").alias("best_by_rmse"), (F.col("a.mae") - F.col("base_mae")).alias("mae_delta"), (F.col("base_rmse") - F.col("r.rmse")).alias("rmse_gain"))
    loss, gain = F.col("mae_delta"), F.col("rmse_gain")
    wins = (loss <= 0.05) & F.when(loss > 0.01, gain > 0.05).otherwise(gain > 0.03)
    return one.withColumn("recommended", F.when(F.coalesce(wins, F.lit(False)), F.col("best_by_rmse")).otherwise(baseline)).withColumn("worth_a_forest", F.coalesce(gain > 0.05, F.lit(False)))


def runnable(models: DataFrame, rows: DataFrame, slow: Sequence[str], most_rows: int = 500_000, forced: bool = False) -> DataFrame:
    """model, n_rows and skipped: slow models are left out above a number of rows, unless forced. rows: the training rows."""
    n = F.broadcast(rows.agg(F.count("*").alias("n_rows")))
    return models.join(n).withColumn("skipped", F.col("model").isin(*slow) & (F.col("n_rows") > most_rows) & F.lit(not forced))


def sample_run(test: DataFrame, events: DataFrame, least_rows: int = 10_000, least_events: int = 100_000) -> DataFrame:
    """One row: the sizes of a run, and whether it is too small for a decision."""
    one = test.agg(F.count("*").alias("n_test")).join(F.broadcast(events.agg(F.count("*").alias("n_events"))))
    return one.withColumn("is_sample", (F.col("n_test") < least_rows) | (F.col("n_events") < least_events))


def threshold_strategies(grid: DataFrame, fixed: Mapping[str, float] | None = None, default: float = 0.5) -> DataFrame:
    """model, strategy and threshold: the default, the best of the grid (of the test split), and fixed ones of some models."""
    out = grid.select("model").distinct().select("model", F.lit("default").alias("strategy"), F.lit(default).alias("threshold"))
    out = out.unionByName(best_threshold(grid, default).select("model", F.lit("best_on_test").alias("strategy"), "threshold"))
    for model, threshold in (fixed or {}).items():
        out = out.unionByName(grid.where(F.col("model") == model).select("model").distinct().select("model", F.lit("fixed").alias("strategy"), F.lit(threshold).alias("threshold")))
    return out


def variant_deltas(table: DataFrame, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of each model and variant on both splits ('test', 'val') side by side, and their differences from the model's baseline variant."""
    wide = table.groupBy("model", "variant").agg(*(F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for m in metrics for s in ("test", "val")))
    names = [f"{s}_{m}" for m in metrics for s in ("test", "val")]
    base = wide.where(F.col("variant") == baseline).select("model", *(F.col(n).alias(f"__{n}") for n in names))
    return wide.join(base, "model").withColumns({f"delta_{n}": F.col(n) - F.col(f"__{n}") for n in names}).drop(*(f"__{n}" for n in names))


def best_variants(deltas: DataFrame, order: Sequence[str] = ("test_f1", "test_precision", "test_recall")) -> DataFrame:
    """The variant of each model with the highest metrics on test."""
    return best_per(deltas, ["model"], [*(F.desc(c) for c in order), F.asc("variant")])


def overall_decision(deltas: DataFrame, sizes: DataFrame, primary: str, baseline: str, metrics: tuple[str, str] = ("f1", "pr_auc"), least_gain: float = 0.002) -> DataFrame:
    """One row: decision and, if one qualifies, the variant of the primary model.

    A variant qualifies by either metric: a gain of `least_gain` on test and no loss on val. sizes: a
    row of `sample_run`; runs on samples decide nothing. Without the primary model there is no decision either.
    """
    passes = [(F.col(f"delta_test_{m}") >= least_gain) & (F.col(f"delta_val_{m}") >= 0) for m in metrics]
    gain = F.greatest(*(F.col(f"delta_test_{m}") for m in metrics))
    own = deltas.where((F.col("model") == primary) & (F.col("variant") != baseline)).withColumn("qualifies", passes[0] | passes[1])
    order = F.struct(gain, *(F.col(f"delta_val_{m}") for m in metrics), F.col("delta_test_recall"))
    one = own.agg(F.count("*").alias("n_variants"), F.count_if("qualifies").alias("n_qualified"), F.max_by("variant", F.when(F.col("qualifies"), order)).alias("winner"))
    decision = F.when(F.col("is_sample"), "sample run, no decision").when(F.col("n_variants") == 0, "primary model missing, no decision").when(F.col("n_qualified") > 0, "keep as challenger").otherwise("do not adopt")
    return one.join(F.broadcast(sizes)).select(F.lit(primary).alias("primary_model"), "n_test", "n_events", "is_sample", "n_variants", "n_qualified", decision.alias("decision"), F.when(decision == "keep as challenger", F.col("winner")).alias("winner"))


def winners(results: DataFrame) -> DataFrame:
    """Per task: the highest F1 for 'cls', the lowest error for 'reg'; failed rows never win."""
    score = F.when(F.col("task") == "cls", F.col("f1")).otherwise(-F.col("mae"))
    return best_per(results.where("status = 'ok'").withColumn("__s", score), ["task"], [F.desc("__s"), F.asc("model"), F.asc("variant")]).drop("__s")
