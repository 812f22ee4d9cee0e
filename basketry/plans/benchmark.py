"""The model benchmark over written or prepared frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import clean, decide, metrics, models, sampling
from basketry.sources import sinks

COLUMNS = "task string, variant string, model string, status string, error string, n_train long, n_eval long, f1 double, precision double, recall double, accuracy double, mcc double, roc_auc double, average_precision double, log_loss double, mae double, rmse double, r2 double, median_ae double, seconds double"


def run(train: DataFrame, evaluation: DataFrame, features: dict[str, list[str]], cap_train: int | None = 200_000, cap_eval: int | None = 100_000, classifiers=models.CLASSIFIERS, regressors=models.REGRESSORS, ledger: str | None = None, run_name: str = "run") -> DataFrame:
    """One row for each task, variant and model. features: by variant. Caps are stratified by class; None for none.

    ledger: a folder in which each row is kept as soon as it is there; a run of the same name goes on
    with what it lacks, and keeps its rows of errors.
    """
    spark, rows = train.sparkSession, []
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    floats = {c.split()[0] for c in COLUMNS.split(", ") if c.endswith("double")}
    kept = None if ledger is None else sinks.RunLedger(spark, ledger, run_name, COLUMNS, ("task", "variant", "model"))
    done = set() if kept is None else kept.done()
    for task in ("cls", "reg"):
        target = "order" if task == "cls" else "quantity"
        keep = (lambda df: df.where(F.col("order").isNotNull())) if task == "cls" else (lambda df: df.where(clean.stage2()))
        sides = []
        for df, cap in ((keep(train), cap_train), (keep(evaluation), cap_eval)):
            if cap is not None and df.count() > cap:
                df = sampling.class_stratified(df, target, cap) if task == "cls" else sampling.uniform(df, cap)
            sides.append(df.persist())
        t, e = sides
        sizes = {"n_train": t.count(), "n_eval": e.count()}
        for variant, columns in features.items():
            for kind in classifiers if task == "cls" else regressors:
                if (task, variant, kind) in done:
                    continue
                row = models.attempted(kind, task, lambda: _one(t, e, columns, kind, task, target)) | {"variant": variant} | sizes
                rows.append({n: None if row.get(n) is None else float(row[n]) if n in floats else row[n] for n in names})
                if kept is not None:
                    kept.add(rows[-1])
        for df in sides:
            df.unpersist()
    return kept.rows() if kept is not None else spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)


def _one(train: DataFrame, evaluation: DataFrame, features: list[str], kind: str, task: str, target: str) -> dict:
    if kind in ("most_frequent", "median", "mean", "always_1"):
        out = models.baseline(train, evaluation, kind, target)
        if task == "cls":
            return models.evaluate_classifier(out.withColumnRenamed("prediction", "score"))
        return metrics.regression(out).first().asDict()
    if task == "cls":
        return models.evaluate_classifier(models.score_classifier(models.fit_classifier(train, features, kind, target), evaluation, features, target))
    return metrics.regression(models.score_regressor(models.fit_regressor(train, features, kind, target), evaluation, features, kind, target)).first().asDict()


def best(results: DataFrame) -> DataFrame:
    return decide.winners(results)
