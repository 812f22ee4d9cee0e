"""Sinks: Parquet, CSV, text, JSON, exports with their manifest, and run manifests.

Data is written by Spark to any store that it reaches; small driver-side texts go through Spark's
file system too, so a path may be remote.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.schema import EXPORT_PREFIX, TEXT_IN_EXPORTS, require_columns

#: The columns of an export manifest.
MANIFEST = "file_name string, stage string, split string, n_rows long, n_features int, target_name string, feature_set_name string, sampling_used boolean, sampling_frac double, build_mode string, source_pipeline string, reg_mask_applied boolean, created_at string"


def at_once(*jobs: Callable[[], object], most: int = 4) -> None:
    """Runs independent writes side by side, so that small ones do not leave the executors idle; an error of one is raised."""
    with ThreadPoolExecutor(most) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def save_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> str:
    """one_file: for reports; large tables are written in parts."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def save_text(spark: SparkSession, text: str, path: str) -> str:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def save_json(spark: SparkSession, value, path: str) -> str:
    return save_text(spark, json.dumps(value, indent=2, default=str) + "\n", path)


def append_json(df: DataFrame, path: str) -> str:
    df.write.mode("append").json(path)
    return path


class RunLedger:
    """Rows of a run that are kept as soon as each is there, so that a broken run goes on where it stopped.

    A row is appended once its work has ended, well or with an error, under a key within the run; before
    the work the ledger is asked for that key. A row that was written twice, by a run that broke
    between its work and its note of it, counts once.
    """

    def __init__(self, spark: SparkSession, path: str, run: str, schema: str, key: Sequence[str]):
        self.spark, self.path, self.run, self.schema, self.key = spark, path, run, f"run string, {schema}", tuple(key)

    def rows(self) -> DataFrame:
        """All rows of the run."""
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema).drop("run")
        held = self.spark.read.schema(self.schema).json(self.path).where(F.col("run") == self.run)
        return held.dropDuplicates(["run", *self.key]).drop("run")

    def done(self) -> set[tuple]:
        """The keys of the run's rows; as many as the run has pieces of work."""
        return {tuple(r[k] for k in self.key) for r in self.rows().select(*self.key).collect()}

    def add(self, row: Mapping) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        one = self.spark.createDataFrame([tuple(({"run": self.run} | dict(row)).get(n) for n in names)], self.schema)
        append_json(one.coalesce(1), self.path)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def export_frame(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features in order and the target last, categories as text, with a prefix where they look like numbers."""
    require_columns(df.columns, [*features, target], "export")

    def shown(c: str):
        x = F.col(c)
        if c in EXPORT_PREFIX:
            return F.when(x.isNotNull(), F.concat(F.lit(EXPORT_PREFIX[c]), x.cast("string"))).alias(c)
        return x.cast("string").alias(c) if c in TEXT_IN_EXPORTS else x

    return df.select(*(shown(c) for c in features), target)


@dataclass(frozen=True)
class Export:
    """A frame to be written for an outside tool: rows of a stage ('CLS', 'REG') and split, and the share of rows if they are a sample."""

    rows: DataFrame
    features: Sequence[str]
    target: str
    stage: str
    split: str
    feature_set: str
    fraction: float | None = None


def export_csvs(exports: Mapping[str, Export], folder: str, mode: str) -> DataFrame:
    """Writes each export and returns the manifest, one row for each file.

    What was written is read again: the columns must be those asked for, and no target may be missing.
    """
    spark, rows = None, []
    for name, e in exports.items():
        spark = e.rows.sparkSession
        path = save_csv(export_frame(e.rows, e.features, e.target), f"{folder}/{name}.csv")
        back = spark.read.option("header", True).csv(path)
        n = back.agg(F.count("*").alias("n"), F.count_if(F.col(e.target).isNull()).alias("missing")).first()
        if back.columns != [*e.features, e.target] or n["missing"]:
            raise ValueError(f"export {name}: columns or target differ from what was asked for")
        rows.append((f"{name}.csv", e.stage, e.split, n["n"], len(e.features), e.target, e.feature_set, e.fraction is not None, e.fraction, mode, "build", e.stage == "REG", datetime.now(timezone.utc).isoformat(timespec="seconds")))
    return spark.createDataFrame(rows, MANIFEST)


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """path and size in bytes of all files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("n_bytes"))


def run_manifest(spark: SparkSession, folder: str, mode: str, counts: Mapping[str, int], seconds: float) -> None:
    """RUN_MANIFEST as Markdown and JSON."""
    value = {"mode": mode, "written_at": datetime.now(timezone.utc).isoformat(), "seconds": round(seconds, 2), "counts": dict(counts)}
    save_json(spark, value, f"{folder}/RUN_MANIFEST.json")
    lines = ["# Run manifest", "", f"* mode: {mode}", f"* seconds: {seconds:.2f}", "", "| table | rows |", "| --- | --- |", *(f"| {n} | {v} |" for n, v in counts.items())]
    save_text(spark, "\n".join(lines) + "\n", f"{folder}/RUN_MANIFEST.md")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table as Markdown; for frames of a few rows. More than `limit` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has at most {limit} rows; this frame has more")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])
