"""Models on pyspark.ml: baselines, linear and tree models, encoders, selection, and exact evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators import metrics
from basketry.operators.ordered import place_of_keys, written

#: A category of more values is a number to the tree models: the commonest, one less than this, are ordered by their target, and all others share an overflow code.
MOST_CATEGORIES = 255
#: Rows that the overall mean counts for in the mean target of a value.
SMOOTHING = 20.0
#: Boosting: rounds at most, the share of training rows that tell when to stop, and how little a round must gain there.
ROUNDS, VALIDATION_SHARE, LEAST_GAIN = 40, 0.1, 0.001


def split_types(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, text) features."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return [c for c in features if c not in texts], [c for c in features if c in texts]


def with_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """n / (2 n_c) for each class."""
    counts = df.groupBy(F.col(target).alias("__c")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    return df.join(F.broadcast(counts.join(F.broadcast(total))), F.col(target) == F.col("__c")).withColumn(name, F.col("__t") / (2 * F.col("__n"))).drop("__c", "__n", "__t")


def ordered_codes(train: DataFrame, column: str, target: str, most: int = MOST_CATEGORIES) -> DataFrame:
    """value, n, mean (smoothed) and code of a category, for trees that take it as a number.

    The `most` - 1 commonest values get codes from 0 in the order of their smoothed mean target, which
    is the order in which a tree would split them; all others, and values that training has not seen,
    have the code that follows. Ties: by value.
    """
    rows = train.select(F.coalesce(F.col(column).cast("string"), F.lit("MISSING")).alias("value"), F.col(target).cast("double").alias("y")).where("y is not null")
    counts = written(rows.groupBy("value").agg(F.count("*").alias("n"), F.sum("y").alias("s")))
    overall = counts.agg((F.sum("s") / F.sum("n")).alias("__all"))
    kept = place_of_keys(counts, "n", "value").where(F.col("rank") < most).join(F.broadcast(overall))
    mean = (F.col("s") + SMOOTHING * F.col("__all")) / (F.col("n") + SMOOTHING)
    # Fewer than `most` rows.
    return kept.select("value", "n", mean.alias("mean")).withColumn("code", (F.row_number().over(Window.orderBy(F.round("mean", 12), "value")) - 1).cast("int"))


def preparation(df: DataFrame, features: Sequence[str], one_hot: bool, scale: bool, target: str | None = None) -> list:
    """Stages from raw columns to the vector `features`: median or constant imputation, codes, one-hot, scaling.

    target: for trees, whose categories of more than MOST_CATEGORIES values then become numbers (`ordered_codes`).
    """
    numeric, texts = split_types(df, features)
    stages, inputs = [], []
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric]))
        inputs += [f"{c}__i" for c in numeric]
    many = []
    if texts and not one_hot and target is not None:
        sizes = df.agg(*(F.count_distinct(c).alias(c) for c in texts)).first()
        many = [c for c in texts if sizes[c] > MOST_CATEGORIES]
    for c in many:
        labels = [r["value"] for r in ordered_codes(df, c, target).orderBy("code").collect()]
        # Codes by the order of the labels; an addition makes them numbers to the trees.
        stages.append(StringIndexerModel.from_labels(labels, inputCol=c, outputCol=f"{c}__k", handleInvalid="keep"))
        stages.append(SQLTransformer(statement=f"SELECT *, `{c}__k` + 0D AS `{c}__s` FROM __THIS__"))
    for c in (x for x in texts if x not in many):
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__s", handleInvalid="keep", stringOrderType="alphabetAsc"))
    if texts and one_hot:
        stages.append(OneHotEncoder(inputCols=[f"{c}__s" for c in texts], outputCols=[f"{c}__h" for c in texts], handleInvalid="keep"))
    inputs += [f"{c}__{'h' if one_hot else 's'}" for c in texts]
    raw = "features_raw" if scale else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=False, withStd=True))
    return stages


def _ready(df: DataFrame, features: Sequence[str]) -> DataFrame:
    numeric, texts = split_types(df, features)
    return df.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(c, F.lit("MISSING")) for c in texts})


def classifier(kind: str, rows: int, target: str = "order"):
    """An unfitted classifier by name. rows: training rows, for penalties that are stated per row."""
    if kind == "logistic_balanced":
        return LogisticRegression(labelCol=target, weightCol="weight", maxIter=100)
    if kind in ("l1", "elastic_net"):
        return LogisticRegression(labelCol=target, weightCol="weight", regParam=1 / (0.1 * max(rows, 1)), elasticNetParam=1.0 if kind == "l1" else 0.5, maxIter=100)
    if kind == "boosted":
        return GBTClassifier(labelCol=target, weightCol="weight", maxIter=ROUNDS, stepSize=0.2, maxDepth=5, maxBins=512, validationIndicatorCol=VALIDATION, validationTol=LEAST_GAIN, seed=42)
    raise KeyError(kind)


def regressor(kind: str, rows: int, target: str = "quantity"):
    if kind == "ridge":
        return LinearRegression(labelCol=target, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False)
    if kind in ("lasso", "elastic_net"):
        return LinearRegression(labelCol=target, regParam=0.01, elasticNetParam=1.0 if kind == "lasso" else 0.5, standardization=False)
    if kind in ("boosted", "boosted_log"):
        return GBTRegressor(labelCol="log_target" if kind.endswith("log") else target, maxIter=ROUNDS, stepSize=0.2, maxDepth=5, maxBins=512, validationIndicatorCol=VALIDATION, validationTol=LEAST_GAIN, seed=42)
    if kind == "forest":
        return RandomForestRegressor(labelCol=target, numTrees=30, maxDepth=10, minInstancesPerNode=50, maxBins=512, seed=42)
    raise KeyError(kind)


#: Marks the training rows that boosting is stopped by.
VALIDATION = "__validation"


def with_validation(df: DataFrame, key: str = "lineID", share: float = VALIDATION_SHARE) -> DataFrame:
    """df with VALIDATION: true for a share of the rows by a hash of the key, so the same rows in every run. Without the key, a hash of the row."""
    h = F.xxhash64(key) if key in df.columns else F.xxhash64(*df.columns)
    return df.withColumn(VALIDATION, F.pmod(h, F.lit(1000)) < int(1000 * share))


CLASSIFIERS = ("most_frequent", "logistic_balanced", "boosted")
REGRESSORS = ("always_1", "median", "ridge", "boosted", "boosted_log", "forest")


def fit_classifier(train: DataFrame, features: Sequence[str], kind: str, target: str = "order") -> PipelineModel:
    ready = with_validation(with_class_weights(_ready(train, features), target))
    linear = kind != "boosted"
    return Pipeline(stages=[*preparation(ready, features, one_hot=linear, scale=linear, target=target), classifier(kind, train.count(), target)]).fit(ready)


def boosting_curve(model: PipelineModel, train: DataFrame, features: Sequence[str], target: str = "order") -> DataFrame:
    """round, the loss on the rows that boosting is stopped by, and whether the model ends with that round.

    The loss is that of the boosted trees (log loss of the doubled margin for classes, squared error for quantities).
    """
    marked = with_validation(with_class_weights(_ready(train, features), target) if target == "order" else _ready(train, features).withColumn("log_target", F.log1p(target)))
    ready = marked.where(VALIDATION)
    for stage in model.stages[:-1]:
        ready = stage.transform(ready)
    trees = model.stages[-1]
    losses = trees.evaluateEachIteration(ready) if isinstance(trees, GBTClassificationModel) else trees.evaluateEachIteration(ready, "squared")
    return train.sparkSession.createDataFrame([(k, float(x), k == len(losses)) for k, x in enumerate(losses, 1)], "round int, loss double, last boolean")


def score_classifier(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str = "order", keep: Sequence[str] = ()) -> DataFrame:
    """y and the probability of the positive class."""
    return model.transform(_ready(df, features)).select(*keep, F.col(target).cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))


def numbered(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, dict[str, str], list]:
    """df with a number for each feature, the names of these columns, and the stages that come after them."""
    first = next(k for k, s in enumerate(model.stages) if isinstance(s, (OneHotEncoderModel, VectorAssembler)))
    _, texts = split_types(df, features)
    columns = {f: f"{f}__{'s' if f in texts else 'i'}" for f in features}
    return PipelineModel(model.stages[:first]).transform(_ready(df, features)), columns, model.stages[first:]


def with_vector(stages: Sequence, df: DataFrame, numbers: Mapping[str, Column], name: str) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """df with the vector, as an array, that the stages after `numbered` and before the model make of numbers (feature: column), and where a feature lies in it: its first place and how many."""
    wide = PipelineModel(list(stages)).transform(df.select("*", *numbers.values()))
    at, places = 0, {}
    for c in next(s for s in stages if isinstance(s, VectorAssembler)).getInputCols():
        places[c.rpartition("__")[0]] = at, (n := wide.schema[c].metadata["ml_attr"]["num_attrs"] if c.endswith("__h") else 1)
        at += n
    return wide.select(*df.columns, vector_to_array("features").alias(name)), places


def fit_regressor(train: DataFrame, features: Sequence[str], kind: str, target: str = "quantity") -> PipelineModel:
    ready = with_validation(_ready(train, features).withColumn("log_target", F.log1p(target)))
    linear = kind in ("ridge", "lasso", "elastic_net")
    return Pipeline(stages=[*preparation(ready, features, one_hot=linear, scale=False, target=target), regressor(kind, train.count(), target)]).fit(ready)


def score_regressor(model: PipelineModel, df: DataFrame, features: Sequence[str], kind: str, target: str = "quantity", low: float | None = None) -> DataFrame:
    p = F.col("prediction")
    p = F.expm1(p) if kind.endswith("log") else p
    out = model.transform(_ready(df, features)).select(F.col(target).alias("y"), p.alias("prediction"))
    return out if low is None else out.withColumn("prediction", F.greatest("prediction", F.lit(low)))


def baseline(train: DataFrame, df: DataFrame, kind: str, target: str) -> DataFrame:
    """y with a constant prediction fitted on the training rows."""
    value = {"most_frequent": F.mode(target), "median": F.median(target), "mean": F.avg(target), "always_1": F.lit(1.0)}[kind]
    return df.select(F.col(target).alias("y")).join(F.broadcast(train.agg(value.cast("double").alias("prediction"))))


def attempted(name: str, task: str, run: Callable[[], Mapping[str, float]]) -> dict:
    """The metrics of a model with its status; a failure becomes a row, so that the others still run."""
    began = time.time()
    try:
        return {"task": task, "model": name, "status": "ok", "error": None, **run(), "seconds": round(time.time() - began, 3)}
    except Exception as e:  # noqa: BLE001
        return {"task": task, "model": name, "status": "failed", "error": str(e), "seconds": round(time.time() - began, 3)}


def evaluate_classifier(scored: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    scored = scored.persist()
    try:
        row = metrics.confusion(scored, threshold).first().asDict()
        return row | {"roc_auc": metrics.roc_auc(scored).first()[0], "average_precision": metrics.average_precision(scored).first()[0], "log_loss": metrics.log_loss(scored).first()[0]}
    finally:
        scored.unpersist()


def importances(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature and importance, the importances of a category's columns summed; for trees by gain, for linear models by absolute coefficient."""
    fitted = model.stages[-1]
    values = fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else abs(fitted.coefficients.toArray())
    attrs = model.transform(_ready(df.limit(1), features)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    sums: dict[str, float] = {f: 0.0 for f in features}
    for k, v in enumerate(values):
        base = names.get(k, "").split("__")[0]
        if base in sums:
            sums[base] += float(v)
    return df.sparkSession.createDataFrame([(f, v, v > 1e-12) for f, v in sums.items()], "feature string, importance double, selected boolean").orderBy(F.desc("importance"), "feature")


def family_ablation(train: DataFrame, test: DataFrame, families: Mapping[str, Sequence[str]], kind: str = "logistic_balanced", core: Sequence[str] = (), target: str = "order") -> DataFrame:
    """Average precision without each family and with each family added to the core, and the differences."""
    every = [c for fs in families.values() for c in fs]

    def ap(features: Sequence[str]) -> float:
        return metrics.average_precision(score_classifier(fit_classifier(train, features, kind, target), test, features, target)).first()[0]

    full, low = ap(every), ap(core) if core else None
    rows = []
    for name, fs in families.items():
        rest = [c for c in every if c not in fs]
        rows.append((name, "without", a := ap(rest), a - full))
        if core and not set(fs) <= set(core):
            rows.append((name, "added", a := ap([*core, *(c for c in fs if c not in core)]), a - low))
    return train.sparkSession.createDataFrame(rows, "family string, change string, average_precision double, delta double")
