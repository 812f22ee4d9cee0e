"""The registered queries against their SQL, the ledger's versions, repeated rows, clashing names, and the pipeline's stages."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import licenses, neighbours, queries, secret_scan, simhash
from basketry.llm.oracle import oracle_sql

DATA = "/root/testdata/sf0.01"
AWKWARD = [(1, None), (1, None), (None, ""), (2, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "word " * 100_000), (4, " \n\t ")]


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", ["op1_secret_scan", "op3_url_filter", "op7_license_scan", "op8_quality_rules", "op12_centroids", "op13_divergence"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(rel.columns)
    assert bag(df.select(*rel.columns).collect()) == bag(rel.fetchall())


def test_a_changed_rule_leaves_no_finding_behind(spark, tmp_path):
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/ledger")
    rows = spark.createDataFrame([("a", "x 123456 y 789"), ("b", "789")], "path string, text string")
    found = lambda pattern: {r["path"]: r["f"] for r in secret_scan.scan_versions(rows, ["path"], ledger=ledger, rules=(secret_scan.Rule("digits", pattern),)).select("path", secret_scan.joined(F.col("findings")).alias("f")).collect()}
    loose = {"a": "digits:2:5,digits:5:8,digits:11:14", "b": "digits:0:3"}
    assert found("[0-9]{3}") == loose
    assert found("[0-9]{6}") == {"a": "digits:2:8", "b": ""}
    size = ledger.read().count()
    assert found("[0-9]{3}") == loose and ledger.read().count() == size  # both versions are known now
    other = secret_scan.scan_versions(spark.createDataFrame([("c", "1234")], "path string, text string"), ["path"], ledger=ledger, rules=(secret_scan.Rule("digits", "[0-9]{3}"),))
    assert other.count() == 1


def test_redaction_with_clashing_names_and_touching_spans(spark):
    names = "id long, text string, n_chars long, blob string, found_blob string, findings string, __findings string"
    rows = spark.createDataFrame([(1, "a" * 24 + "AKIA" + "B" * 16, 44, *"wxyz"), (2, None, 0, *"wxyz"), (3, "token=token=abcdefg", 19, *"wxyz")], names)
    got = {r["id"]: r for r in secret_scan.redact(rows).collect()}
    assert secret_scan.redact(rows).columns == rows.columns and got[1]["findings"] == "y"
    assert [got[k]["text"] for k in (1, 2, 3)] == ["[SECRET]", None, "[SECRET]"] and got[1]["n_chars"] == 8
    assert secret_scan.redact(rows.limit(0)).count() == 0


def test_keep_one_of_each_with_clashing_names(spark):
    rows = [(i, t, 1, 2, 3, "x") for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, own_id int, place int, best_id string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_a_hot_group_keeps_one_name(spark):
    rng = np.random.default_rng(4)
    base = " ".join(f"w{k}" for k in range(400)).split()
    rows = [(k, " ".join(base[:400] if k % 3 else [*base[:390], *(f"v{x}" for x in rng.integers(0, 9, 3)), *base[393:]])) for k in range(600)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=16)
    assert got.select("component_id").distinct().count() == 1 and got.select("fingerprint").distinct().count() > 1 and got.count() == 600


def test_repeated_queries_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8))
    x[1:13] = x[0]  # twelve copies of the query at distance 0
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    table = spark.createDataFrame([*rows, rows[100], rows[100], (200, rows[7][1])], "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 100 == 0).collect()
    of = lambda q: sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
    nearest = [k for k in np.lexsort((np.arange(400), np.sqrt(((x - x[100]) ** 2).sum(1)))) if k != 100][:10]
    found = [v for _, v, _ in of(100)]
    assert [r for r, _, _ in of(100)] == list(range(1, 11)) and len(set(found)) == 10 and len(set(found) & set(nearest)) >= 8
    assert of(0) == [(k, k, 0.0) for k in range(1, 11)]  # ties go to smaller ids
    assert sorted(r for r, _, _ in of(200)) == sorted([*range(1, 11)] * 2)  # one id with two vectors asks twice


def test_license_scan_of_awkward_tables(spark):
    mit = licenses.TEXTS["MIT"]
    rows = spark.createDataFrame([(1, mit, "x"), (1, mit, "x"), (None, mit, "x"), (2, mit + " word" * 200_000, "x"), (3, None, "x")], "doc_id long, text string, license_id string").withColumn("digest", F.lit(1))
    got = licenses.scan(rows).collect()
    assert collections.Counter((r["doc_id"], r["license_id"]) for r in got) == {(1, "MIT"): 2, (None, "MIT"): 1, (2, None): 1, (3, None): 1}


def test_digest_columns_of_the_secret_query(spark, tmp_path):
    rows = spark.createDataFrame([(2, "token=abcdefgh -----BEGIN PRIVATE KEY-----"), (3, None)], "doc_id long, text string")
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op1_secret_scan(spark, f"file://{tmp_path}").collect()}
    assert (got[2]["n_assign"], got[2]["spans"]) == (1, "assign:0:14,private_key:15:42")
    assert got[2]["base_sha256"] == hashlib.sha256(b"assign:0:14").hexdigest() and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_stages_on_awkward_tables(spark):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "quality": F.lit(2), "blob": F.lit(3)})
    kept = {"toxicity": 7, "quality rules": 0, "near-duplicates": 3, "secrets": 7}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == kept[name], name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, DATA)
    assert pieces.groupBy("doc_id").agg(F.sum("length")).count() == 5 and pieces.where("doc_id = 1").count() == 2


def test_toxic_documents_go(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").cache()
    kept = corpus_pipeline.drop_toxic(spark, docs, data).select("doc_id").withColumn("kept", F.lit(True))
    held = labels.where(queries.held_out("doc_id")).join(kept, "doc_id", "left").groupBy("toxic").agg(F.avg(F.col("kept").isNull().cast("int")).alias("gone"))
    gone = {r["toxic"]: r["gone"] for r in held.collect()}
    assert gone[1] > 0.94 and gone[0] < 0.04


def test_registered_toxicity_columns(spark):
    got = queries.op5_toxicity(spark, DATA).toPandas()
    import zlib

    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()


def test_number_words_of_the_pipeline(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count()
    assert fill == 0 and re.search("doc_tokens", " ".join(packed.columns))
