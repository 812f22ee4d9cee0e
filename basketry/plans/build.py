"""The dataset build: from the two tables to matrices, samples, audits and exports."""

from __future__ import annotations

import time
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import schema
from basketry.functions.numeric import week_block
from basketry.operators import audit, clean, features, guards, history, sampling, segment
from basketry.operators.encoding_store import EncodingStore, encoded, later_history
from basketry.operators.ordered import written
from basketry.schema import Config
from basketry.sources import sinks

STAGES = {"cls": "order", "reg": "quantity"}


@dataclass
class Artefacts:
    """What is fitted on the training rows; small frames, joined by `apply`."""

    edges: DataFrame
    segments: DataFrame
    frequency: DataFrame


def base(fact: DataFrame, dim: DataFrame, config: Config) -> DataFrame:
    df = clean.prepare(fact, dim, config).where("split is not null")
    return features.safe_row_features(df.withColumn("week_block", week_block(F.col("day"), config.train_days[0])))


def save_artefacts(a: Artefacts, folder: str) -> str:
    """What was fitted, as Parquet, so that later rows can be scored with it."""
    for f in fields(a):
        sinks.save_parquet(getattr(a, f.name), f"{folder}/{f.name}.parquet")
    return folder


def load_artefacts(spark: SparkSession, folder: str) -> Artefacts:
    return Artefacts(**{f.name: spark.read.parquet(f"{folder}/{f.name}.parquet") for f in fields(Artefacts)})


def fit(df: DataFrame, config: Config) -> Artefacts:
    train = df.where("split = 'train'")
    return Artefacts(features.fit_edges(train, bins=config.bins), segment.fit_segments(train), features.fit_frequency(train, "manufacturer"))


def apply(df: DataFrame, a: Artefacts) -> DataFrame:
    df = features.apply_edges(df, a.edges, "price_diff", "price_diff_bin", "NO_COMPETITOR_PRICE")
    df = features.apply_edges(df, a.edges, "price_discount", "discount_bin", "NO_RRP")
    df = segment.apply_segments(df, a.segments)
    return features.lookup(df, a.frequency, "manufacturer", "manufacturer_freq", F.lit(0.0))


def conditional(df: DataFrame, config: Config) -> DataFrame:
    """History over all splits, then means and forward encodings that are learnt from training rows only.

    df is read from a written table: all statistics are aggregates of that table, so each step adds
    one join to the plan.
    """
    train = df.where("split = 'train'")
    df = history.cumulative(df, first_day=config.train_days[0])
    for column, name in (("group12", "group12_order"), ("group34", "group34_order"), ("week_block", "week_order")):
        df = features.target_encode(df, train, column, "order", name)
    later = df.where("split <> 'train'")
    own = df.where("split = 'train'")
    for e in history.ENCODINGS:
        own = history.forward_encode(own, e, source=train)
        known = train if e.history is None else train.where(e.history)
        later = features.target_encode(later, known, e.group, e.target, e.name, F.lit(e.cold_start))
    return own.unionByName(later)


def store_of(spark: SparkSession, folder: str) -> EncodingStore:
    """The sums that a build of mode safe_plus_conditional has left, to be read or added to."""
    return EncodingStore(spark, f"{folder}/metadata/encodings")


def score_later(fact: DataFrame, dim: DataFrame, folder: str, config: Config = Config()) -> DataFrame:
    """Rows that come after all rows of a build, with every feature, from what the build has stored; its fact is not read."""
    spark = fact.sparkSession
    df = clean.prepare(fact, dim, config)
    df = features.safe_row_features(df.withColumn("week_block", week_block(F.col("day"), config.train_days[0])))
    store = store_of(spark, folder)
    df = apply(df, load_artefacts(spark, f"{folder}/metadata/artefacts"))
    return encoded(later_history(df, store, config.train_days[0]), written(store.cells()))


def matrices(df: DataFrame, mode: str) -> dict[str, tuple[DataFrame, list[str], str]]:
    """name: (frame, features, target) for every stage, set and split, as lazy projections."""
    out = {}
    sets = ["base_safe", "expanded_safe"] + (["conditional", "final"] if mode == "safe_plus_conditional" else [])
    for stage, target in STAGES.items():
        rows = df if stage == "cls" else df.where(clean.stage2())
        for s in sets:
            columns = schema.feature_set(f"{stage}_{s}")
            schema.no_forbidden(columns, stage, s)
            schema.require_columns(df.columns, columns, f"{stage}_{s}")
            for split in ("train", "test", "validation"):
                out[f"{stage}_{s}_{split}"] = (rows.where(F.col("split") == split), columns, target)
    return out


def exports(df: DataFrame, samples: dict[str, DataFrame], config: Config) -> dict[str, sinks.Export]:
    """The files for an outside tool: each stage's splits and training sample with its final features, and its splits without the groups that did not pay."""
    out = {}
    for stage, target in STAGES.items():
        rows = df if stage == "cls" else df.where(clean.stage2())
        final, variant = f"{stage}_final", "no_groups" if stage == "cls" else "no_group34"
        for name, suffix in ((final, ""), (f"{final}_{variant}", f"_{variant}")):
            for split in ("train", "test", "validation"):
                out[f"{stage}_{split}{suffix}"] = sinks.Export(rows.where(F.col("split") == split), schema.feature_set(name), target, stage.upper(), split, name.upper())
        out[f"{stage}_sample_train"] = sinks.Export(samples[stage], schema.feature_set(final), target, stage.upper(), "sample_train", final.upper(), config.sample_fraction)
    return out


def run(fact: DataFrame, dim: DataFrame, folder: str, mode: str = "safe_only", config: Config = Config()) -> dict[str, int]:
    """Writes all outputs and returns the row counts. mode: safe_only or safe_plus_conditional."""
    began, spark = time.time(), fact.sparkSession
    if mode not in ("safe_only", "safe_plus_conditional"):
        raise ValueError(f"unknown mode {mode!r}")
    # What later stages aggregate again is a written table. The last is partitioned by split: every matrix, sample and audit reads only its columns and split.
    guards.require_valid(guards.unique_key(dim, "pid"), "product table")
    featured = f"{folder}/featured"
    first = spark.read.parquet(sinks.save_parquet(base(fact, dim, config), f"{folder}/staging/base.parquet"))
    df = apply(first, load_artefacts(spark, save_artefacts(fit(first, config), f"{folder}/metadata/artefacts")))
    if mode == "safe_plus_conditional":
        safe = spark.read.parquet(sinks.save_parquet(df, f"{folder}/staging/safe.parquet"))
        store_of(spark, folder).add(safe.where("split = 'train'"), safe, "build", config.train_days[0])
        df = conditional(safe, config)
    df.write.mode("overwrite").partitionBy("split").parquet(featured)
    df = spark.read.parquet(featured)
    audit.assert_clean(df, audit.preprocessing_checks(), "cleaning")
    counts = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    frames = matrices(df, mode)
    for name, (rows, columns, target) in frames.items():
        sinks.save_parquet(rows.select(*columns), f"{folder}/matrices/{name}_X.parquet")
        sinks.save_parquet(rows.select(target), f"{folder}/matrices/{name}_y.parquet")
    train = df.where("split = 'train'")
    for name, sample, columns in (("cls", sampling.sample_cls(train, config.sample_fraction), ["pid_segment", "order"]), ("reg", sampling.sample_reg(train, config.sample_fraction), ["pid_segment", "quantity_class"])):
        sinks.save_parquet(sample, f"{folder}/samples/{name}.parquet")
        sinks.save_csv(sampling.compare(train if name == "cls" else train.where(clean.stage2()), sample, columns), f"{folder}/audit/sampling_{name}.csv", one_file=True)
    reports = {"join_quality": audit.join_quality(fact, dim), "missingness": audit.missingness(df.drop("split")), "outliers": audit.outliers(df, ["price", "competitorPrice", "revenue"]), "targets": audit.target_distribution(df)}
    for name, report in reports.items():
        sinks.save_csv(report, f"{folder}/audit/{name}.csv", one_file=True)
    if mode == "safe_plus_conditional":
        samples = {n: spark.read.parquet(f"{folder}/samples/{n}.parquet") for n in STAGES}
        sinks.save_csv(sinks.export_csvs(exports(df, samples, config), f"{folder}/exports", mode), f"{folder}/exports/manifest.csv", one_file=True)
        infos = None
        for e in history.ENCODINGS:
            one = history.fold_info(features.day_cycles(train), e)
            infos = one if infos is None else infos.unionByName(one)
        sinks.save_csv(infos, f"{folder}/metadata/fold_info.csv", one_file=True)
    sinks.save_csv(sinks.outputs(spark, folder), f"{folder}/metadata/outputs.csv", one_file=True)
    sinks.run_manifest(spark, folder, mode, counts, time.time() - began)
    return counts
