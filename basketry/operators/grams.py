"""Linear sub-models of any feature subset from one pass: sums of products of all encoded columns.

Numbers are centred by their training mean, a missing one counting as the mean; a text becomes the mean
target of its value among the training rows, centred too. One pass over the training rows sums the
products of all columns (a task emits its own sums, Spark adds them up). Every least-squares model
with a ridge, of every subset and of both targets, is then a small system of equations on the driver,
whose size is that of the features. A second pass scores all models at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import metrics
from basketry.operators.features import fit_means, lookup
from basketry.operators.models import split_types
from basketry.operators.ordered import written
from basketry.schema import FAMILIES

#: Families that are left out and added as one; fixed values.
MERGED = {"conditional_history": ("conditional_cumulative", "conditional_aggregation"), "conditional_oof_segment": ("conditional_oof", "conditional_segment")}


def ablation_families() -> dict[str, tuple[str, ...]]:
    merged = {m for ms in MERGED.values() for m in ms}
    return {n: fs for n, fs in FAMILIES.items() if n not in merged} | {n: tuple(f for m in ms for f in FAMILIES[m]) for n, ms in MERGED.items()}


class Encoding:
    """What the training rows say about the columns: means of numbers and of the target, and mean targets of texts."""

    def __init__(self, train: DataFrame, features: Sequence[str], target: str):
        self.features, self.target = list(features), target
        self.numbers, self.texts = split_types(train, features)
        train = train.where(F.col(target).isNotNull())
        # One row.
        self.means = train.agg(*(F.avg(c).alias(c) for c in [*self.numbers, target])).first().asDict()
        self.codes = {c: written(fit_means(train, c, target)) for c in self.texts}

    def apply(self, df: DataFrame) -> DataFrame:
        """x: the encoded features in order, y: the centred target, and the target as it is; rows without a target are left out."""
        mean = self.means[self.target]
        for c in self.texts:
            df = lookup(df, self.codes[c], c, f"__code_{c}", F.lit(mean))
        coded = lambda c: F.col(f"__code_{c}") - mean if c in self.texts else F.coalesce(F.col(c).cast("double") - F.lit(self.means[c]), F.lit(0.0))
        target = F.col(self.target).cast("double")
        return df.where(target.isNotNull()).select(F.array(*(coded(c) for c in self.features)).alias("x"), (target - mean).alias("y"), target.alias("target"))


def _products(p: int):
    """From (x, y) to (i, j, value), i <= j: sums of products; place p is y."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((p + 1, p + 1)), 0
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            z = np.column_stack([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p), y])
            total += z.T @ z
            rows += len(y)
        if rows:
            i, j = np.triu_indices(p + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j], rows))], names=["i", "j", "value"])

    return run


def products(encoded: DataFrame, p: int) -> DataFrame:
    """(i, j, value) over all rows; the number of rows at (-1, -1)."""
    return encoded.select("x", "y").mapInArrow(_products(p), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram(train: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(a, b, covariance): the mean product of any two encoded columns, the target among them."""
    e = Encoding(train, features, target)
    names = F.array(*(F.lit(c) for c in [*features, target]))
    sums = written(products(e.apply(train), len(features)))
    rows = F.broadcast(sums.where("i = -1").select(F.col("value").alias("__n")))
    return sums.where("i >= 0").join(rows).select(F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), (F.col("value") / F.col("__n")).alias("covariance"))


def solved(total: np.ndarray, rows: float, columns: Sequence[int], ridge: float) -> np.ndarray:
    """Coefficients of all features, 0 for those that the subset lacks. ridge: as a share of each column's variance."""
    out, p = np.zeros(len(total) - 1), len(total) - 1
    # A column without variance has no say.
    used = [c for c in columns if total[c, c] > 1e-12 * rows]
    if used:
        a = total[np.ix_(used, used)]
        out[used] = np.linalg.solve(a + ridge * np.diag(np.diag(a)), total[used, p])
    return out


def _scored(weights: np.ndarray, mean: float, names: Sequence[str]):
    """From (x, target) to (model, y, score), a row for each model."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(weights)) @ weights + mean
            for k, name in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), b.column(1), pa.array(scores[:, k])], names=["model", "y", "score"])

    return run


def subset_models(train: DataFrame, test: DataFrame, subsets: Mapping[str, Sequence[str]], target: str, ridge: float = 1e-3) -> DataFrame:
    """(model, y, score) of the test rows for the ridge model of each feature subset."""
    features = list(dict.fromkeys(c for s in subsets.values() for c in s))
    e = Encoding(train, features, target)
    total, rows = np.zeros((len(features) + 1,) * 2), 0.0
    # As many rows as there are pairs of features.
    for r in products(e.apply(train), len(features)).collect():
        if r["i"] < 0:
            rows = r["value"]
        else:
            total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["value"]
    weights = np.column_stack([solved(total, rows, [features.index(c) for c in s], ridge) for s in subsets.values()])
    return e.apply(test).select("x", "target").mapInArrow(_scored(weights, e.means[target] or 0.0, list(subsets)), "model string, y double, score double")


def ablation_subsets(features: Sequence[str]) -> dict[tuple[str, str], list[str]]:
    """(experiment, family): features. All; all without each family; the time features alone, and with each other family."""
    families = {n: [f for f in features if f in fs] for n, fs in ablation_families().items()}
    core = families["time"]
    out = {("all", ""): list(features)}
    out |= {("without", n): [f for f in features if f not in fs] for n, fs in families.items() if fs}
    if core:
        out[("core", "time")] = core
        out |= {("added", n): [*core, *fs] for n, fs in families.items() if fs and n != "time"}
    return out


def family_ablation(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, is_class: bool) -> DataFrame:
    """experiment, family, n_features, the metrics of the test rows, and their differences from the model of all features, or of the core where a family is added to it."""
    subsets = ablation_subsets(features)
    label = lambda k: f"{k[0]}:{k[1]}"
    scored = written(subset_models(train, test, {label(k): s for k, s in subsets.items()}, target))
    if is_class:
        found = metrics.average_precision(scored, ["model"]).join(metrics.roc_auc(scored, ["model"]), "model")
        measures = ["average_precision", "roc_auc"]
    else:
        found = metrics.regression(scored.withColumnRenamed("score", "prediction"), ["model"])
        measures = ["mae", "median_ae", "rmse"]
    spark = train.sparkSession
    # A few dozen rows.
    plan = spark.createDataFrame([(label(k), *k, len(s), label(("core", "time") if k[0] == "added" else ("all", ""))) for k, s in subsets.items()], "model string, experiment string, family string, n_features int, base string")
    found = written(found.select("model", *measures))
    base = found.select(F.col("model").alias("base"), *(F.col(m).alias(f"__{m}") for m in measures))
    delta = lambda m: F.when(F.col("experiment").isin("without", "added"), F.col(m) - F.col(f"__{m}")).alias(f"{m}_delta")
    return plan.join(found, "model").join(base, "base").select("experiment", "family", "n_features", *measures, *(delta(m) for m in measures))
