"""The frames that queries and builds start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.numeric import week_block
from basketry.operators import clean, features, metrics
from basketry.operators.ordered import written
from basketry.plans import build
from basketry.schema import Config
from basketry.sources import adapter


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.prepare(adapter.fact(spark, sf_dir), adapter.dim(spark, sf_dir))
    return df.withColumn("week_block", week_block(F.col("day")))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.safe_row_features(prepared(spark, sf_dir))


def safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all splits with every safe feature, as the build writes them; a written table."""
    first = written(build.base(adapter.fact(spark, sf_dir), adapter.dim(spark, sf_dir), Config()))
    return written(build.apply(first, build.fit(first, Config())))


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the conditional features."""
    return written(build.conditional(safe(spark, sf_dir), Config()))


def train_of(df: DataFrame) -> DataFrame:
    return df.where("split = 'train'")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores of the labelled documents: one by length, one by number."""
    docs, labels = adapter.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), adapter.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    both = labels.join(docs, "doc_id")
    models = F.explode(F.array(
        F.struct(F.lit("chars").alias("model"), F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("score")), F.struct(F.lit("id").alias("model"), (F.col("doc_id") % 101 / 100).alias("score"))
    ))
    return both.select("doc_id", "y", models.alias("m")).select("m.model", "doc_id", "y", "m.score")


def split_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold grid by split: documents with even numbers are the test rows, the others the validation rows."""
    split = F.when(F.col("doc_id") % 2 == 0, "test").otherwise("val")
    return metrics.threshold_grid(scored(spark, sf_dir).withColumn("split", split), by=["model", "split"])


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_grid(scored(spark, sf_dir), by=["model"])


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of the later splits with constant baselines and a rule as predictions."""
    rows = prepared(spark, sf_dir).where(clean.stage2()).select("lineID", "split", F.col("quantity").alias("y"))
    constants = F.broadcast(rows.where("split = 'train'").agg(F.avg("y").alias("mean"), F.median("y").alias("median")))
    made = F.explode(F.array(*(
        F.struct(F.lit(m).alias("model"), F.lit(k).alias("kind"), p.cast("double").alias("prediction"))
        for m, k, p in (("always_1", "baseline", F.lit(1.0)), ("mean", "baseline", F.col("mean")), ("median", "baseline", F.col("median")), ("line_rule", "model", F.col("lineID") % 7 / 2))
    )))
    return rows.where("split in ('test', 'validation')").join(constants).select("y", made.alias("m")).select("m.model", "m.kind", "y", "m.prediction")
