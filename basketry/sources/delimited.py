"""Delimited and Parquet sources with contract checks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.schema import DIM_SCHEMA, FACT_SCHEMA, SEGMENT_SCHEMA, require_columns, same_columns

SEPARATORS = ("|", ",", ";", "\t")
#: Cells of metadata rows in exported predictions; fixed values.
METADATA_CELLS = ("continuous", "discrete", "string", "time", "c", "d", "s", "t", "class", "meta", "ignore", "")


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def require_path(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"no input at {path}")
    return path


def header_line(spark: SparkSession, path: str) -> str:
    first = spark.read.text(require_path(spark, path)).limit(1).first()
    return first[0].lstrip("﻿") if first else ""


def detect_separator(spark: SparkSession, path: str) -> str:
    """The commonest of the usual separators in the header; else the commonest other sign; else a comma."""
    line = header_line(spark, path)
    best = max(SEPARATORS, key=line.count)
    if line.count(best):
        return best
    others = re.findall(r"[^\w\s.\"']", line)
    return max(set(others), key=others.count) if others else ","


def read_delimited(spark: SparkSession, path: str, schema: StructType | None = None, sep: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """A delimited file with a header. With a schema, names are checked against the header first, columns are
    matched by name, and a malformed row is an error; columns beyond the schema pass through as text."""
    sep = sep or detect_separator(spark, path)
    header = [c.strip().strip('"') for c in header_line(spark, path).split(sep)]
    reader = spark.read.option("sep", sep).option("header", True)
    if schema is None:
        require_columns(header, required, path)
        return reader.option("inferSchema", True).csv(path)
    require_columns(header, [f.name for f in schema], path)
    known = {f.name: f for f in schema}
    full = StructType()
    for name in header:
        full = full.add(known[name]) if name in known else full.add(name, "string")
    return reader.schema(full).option("mode", "FAILFAST").csv(path)


def read_fact(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return read_delimited(spark, path, FACT_SCHEMA, sep)


def read_dim(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return read_delimited(spark, path, DIM_SCHEMA, sep)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, SEGMENT_SCHEMA)


def read_mapping(spark: SparkSession, candidates: Sequence[str]) -> DataFrame | None:
    """The first of several mapping files (CSV or Parquet) that is there."""
    for path in candidates:
        if exists(spark, path):
            return spark.read.parquet(path) if path.endswith(".parquet") else read_delimited(spark, path)
    return None


def read_predictions(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Predictions exported by a desktop tool, one file or several with the same header: the two rows after a file's header are left out if both hold metadata.

    Rows are known by their position: those of a file's first split are numbered in order, so the
    header has the least number of its file and the two rows the next ones. All other rows stay, also
    such as look like metadata; all columns are read as text and cast. Cells hold no line breaks.
    """
    header = [c.strip().strip('"') for c in header_line(spark, path).split(sep)]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("k"))
    columns = StructType()
    for k in range(len(header)):
        columns = columns.add(f"c{k}", "string")
    cells = lines.withColumn("x", F.from_csv(F.regexp_replace("value", "^\uFEFF", ""), columns.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep}))
    marks = F.lit(True)
    for k in range(len(header)):
        x = F.col(f"x.c{k}")
        marks = marks & (x.isNull() | F.lower(F.trim(x)).isin(*METADATA_CELLS) | x.rlike("^[a-z]+=.*"))
    # A row for each file.
    firsts = lines.where("start = 0").groupBy(F.col("file").alias("of")).agg(F.min("k").alias("first"))
    placed = cells.join(F.broadcast(firsts), F.col("file") == F.col("of"), "left").withColumn("place", F.when(F.col("start") == 0, F.col("k") - F.col("first")))
    held = placed.where(F.col("place").between(1, 2)).groupBy(F.col("file").alias("in")).agg((F.bool_and(marks) & (F.count("*") == 2)).alias("metadata"))
    rows = placed.join(F.broadcast(held), F.col("file") == F.col("in"), "left").where(F.col("place").isNull() | (F.col("place") > F.when(F.coalesce("metadata", F.lit(False)), 2).otherwise(0)))
    # Lines without a sign are no rows.
    return rows.where(F.length(F.trim("value")) > 0).select(*(F.col(f"x.c{k}").try_cast("double").alias(c) for k, c in enumerate(header)))


def load_exports(spark: SparkSession, paths: Mapping[str, str], target: str) -> DataFrame:
    """Exports of several splits as one frame, tagged with `split`; each must hold the target, and all the same columns in the same order."""
    frames = {split: spark.read.option("header", True).option("inferSchema", True).csv(require_path(spark, path)) for split, path in paths.items()}
    same_columns({n: df.columns for n, df in frames.items()}, "exports")
    out = None
    for split, df in frames.items():
        require_columns(df.columns, [target], split)
        one = df.withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


def normalised_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def resolve_column(columns: Sequence[str], wanted: str) -> str:
    """The column that a name means: exactly, normalised, or by holding all of its words; several are an error."""
    if wanted in columns:
        return wanted
    same = [c for c in columns if normalised_name(c) == normalised_name(wanted)]
    words = [w for w in re.split(r"[^a-z0-9]+", wanted.lower()) if w]
    found = same or [c for c in columns if all(w in normalised_name(c) for w in words)]
    if len(found) != 1:
        raise ValueError(f"{wanted!r} fits {found or 'no column'} of {list(columns)}")
    return found[0]


def variants(spark: SparkSession, folder: str, task: str, preferred: Sequence[str] = ("expanded", "base", "conditional")) -> list[str]:
    """Matrix variants of a task that lie in a folder, in order of preference."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    found = {m[1] for n in names if (m := re.match(rf"{task}_(.+)_train_X\.parquet$", n))}
    return [v for v in preferred if v in found] + sorted(found - set(preferred))


def evaluation_split(spark: SparkSession, folder: str, task: str, variant: str) -> str:
    """validation if it was written, else test."""
    return next((s for s in ("validation", "test") if exists(spark, f"{folder}/{task}_{variant}_{s}_X.parquet")), "test")
