"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, centroids, divergence, licenses, neighbours, packing, pii, pu_quality, quality, secret_scan, simhash, toxicity, url_filter
from basketry.llm.common import table

#: The key of the pseudonyms in the registered query; a deployment passes its own.
DEMO_KEY = "registered query"
#: The dated list of the registered query, since no table holds one: kind, key, date, action; fixed values.
LIST_ENTRIES = (
    ("domain", "example.org", "2024-01-15", "add"),
    ("domain", "example.org", "2024-02-10", "remove"),
    ("domain", "example.org", "2024-03-01", "add"),
    ("domain", "example.net", "2024-02-01", "add"),
    ("domain", "example.net", "2024-02-20", "remove"),
    ("host", "thther.example.org", "2024-01-05", "add"),
    ("host", "ththre.example.com", "2024-01-20", "add"),
    ("host", "ththre.example.com", "2024-03-05", "remove"),
    ("host", "m.ththth.example.net", "2024-01-10", "add"),
    ("host", "m.ththth.example.net", "2024-01-10", "remove"),
)


def held_out(id_col: str) -> Column:
    """Labels of these documents are never learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_versions(table(spark, sf_dir, "documents"), ["doc_id"])
    f = F.col("findings")
    base = [r.kind for r in secret_scan.BASE_RULES]
    number_of = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(number_of(k) for k in base),
        F.sha2(secret_scan.joined(f, base), 256).alias("base_sha256"),
        secret_scan.joined(f).alias("spans"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def listed_hosts(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the hosts of the pages and their domains: a hash of the key tells which are listed, since when, and when they are removed."""
    host = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    named = host.select(F.lit("host").alias("kind"), F.col("host").alias("key")).unionByName(host.select(F.lit("domain").alias("kind"), domain.alias("key")).distinct())
    n = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "key")), 1, 6), 16, 10).cast("long")
    at = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")).cast("timestamp")
    added = F.when(n % 4 == 0, F.struct(at(n % 60).alias("listed_at"), F.lit("add").alias("action")))
    removed = F.when(n % 12 == 0, F.struct(at(n % 60 + 1 + n % 25).alias("listed_at"), F.lit("remove").alias("action")))
    return named.select("kind", "key", F.explode(F.array_compact(F.array(added, removed))).alias("e")).select("kind", "key", "e.listed_at", "e.action")


def op3_url_filter(spark: SparkSession, sf_dir: str, entries: DataFrame | None = None) -> DataFrame:
    """entries: a table (kind, key, listed_at, action); without one, the fixed list and what `listed_hosts` makes of the pages."""
    # The table has no fetch times: a capture is fetched (page_id modulo 91) days after 2024-01-01.
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 91).cast("int")).cast("timestamp").alias("fetched_at"))
    if entries is None:
        fixed = spark.createDataFrame(LIST_ENTRIES, "kind string, key string, listed_at string, action string").withColumn("listed_at", F.to_timestamp("listed_at", "yyyy-MM-dd"))
        entries = fixed.unionByName(listed_hosts(pages))
    return url_filter.filter_captures(captures, entries)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), held_out=held_out("label_id"))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.crc32(F.col("id").cast("string")) % 4 == 2
    statistics = pu_quality.with_statistics(table(spark, sf_dir, "documents"))
    model = pu_quality.train(statistics, table(spark, sf_dir, "labels"), held_out=apart)
    scored = pu_quality.scores(statistics, model)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(apart, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_packing, op3_url_filter, op4_bpe, op5_toxicity, op6_pii, op7_license_scan, op8_quality_rules, op9_simhash, op10_ann, op11_quality_classifier, op12_centroids, op13_divergence)
    return {f.__name__: f for f in own}
