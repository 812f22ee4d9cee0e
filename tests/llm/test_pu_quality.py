"""Positive-unlabelled learning: the risk and its gradient, the prior of made mixtures, held-out accuracy, and odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import pu_quality, queries
from basketry.llm.pu_quality import STATISTICS, statistics_of

DATA = "/root/testdata/sf0.1"


def test_statistics_of_texts():
    x = dict(zip(STATISTICS, statistics_of("One two two.\nTHREE 4 !! two two.\n\nOne"), strict=True))
    assert np.isclose(x["log_words"], np.log(10)) and np.isclose(x["distinct_words"], 6 / 9) and np.isclose(x["upper_words"], 1 / 9)
    assert x["same_as_before"] == 0 and np.isclose(x["shouted_words"], 1 / 9) and np.isclose(x["mark_only_words"], 1 / 9) and x["equal_lines"] == 0
    assert np.isclose(statistics_of("a b c a b c d")[STATISTICS.index("repeated_triples")], 2 / 5)
    for text in ("", " \n\t", "x", "日本 語" * 50_000, "\x00 \x1c"):
        assert len(statistics_of(text)) == len(STATISTICS) and np.isfinite(statistics_of(text)).all()


def test_gradient_of_the_risk():
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(size=(30, 5)), rng.normal(size=(40, 5)), rng.normal(size=5)
    _, _, of_p, of_n = pu_quality.risk(w, p, u, 0.4)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        a, b = pu_quality.risk(w + step, p, u, 0.4), pu_quality.risk(w - step, p, u, 0.4)
        assert np.allclose([(a[0] - b[0]) / 2e-6, (a[1] - b[1]) / 2e-6], [of_p[k], of_n[k]], atol=1e-6)


def test_the_estimated_part_of_the_negatives_is_held_at_zero():
    rng = np.random.default_rng(2)
    p, u = rng.normal(size=(40, 60)), rng.normal(size=(80, 60))  # no difference, more columns than positives
    held = pu_quality.risk(pu_quality.minimised(p, u, 0.9), p, u, 0.9)[1]
    assert held > -0.05


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_the_prior_of_a_mixture(prior):
    rng = np.random.default_rng(3)
    good, bad = (lambda n: rng.normal(1.5, 1, (n, len(STATISTICS)))), (lambda n: rng.normal(-1.5, 1, (n, len(STATISTICS))))
    mixed = rng.permutation(np.vstack([good(int(4000 * prior)), bad(4000 - int(4000 * prior))]))
    model = pu_quality.fitted(good(2000), mixed)
    assert abs(model.prior - prior) < 0.05
    assert (model.scores(good(500)) >= 0.7).mean() > 0.97 and (model.scores(bad(500)) < 0.7).mean() > 0.97


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op11_quality_classifier(spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall()
    held = [(got[i], q) for i, q in rows if got[i]["held_out"]]
    assert len(got) == 10_000 and len(held) > 800 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    one, zero = ([r["score"] for r, q in held if q == k] for k in (1, 0))
    assert np.mean([s >= 0.7 for s in one]) > 0.99 and np.mean([s < 0.7 for s in zero]) > 0.93
    assert np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero]) > 0.96


def test_odd_rows(spark):
    texts = [f"Some words of number {k} and more of them." for k in range(40)] + ["!! !! !!"] * 20
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t in enumerate(texts)] + [(None, None, "x", 1.0), (None, "", "x", 1.0), (3, "again", "x", 1.0), (99, "wort " * 200_000, "x", 1.0)], "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(3, 0), (None, 1), (5, None), (200, 1)], "doc_id long, quality int")
    statistics = pu_quality.with_statistics(docs)
    model = pu_quality.train(statistics, labels)
    rows = pu_quality.scores(statistics, model).collect()
    assert len(rows) == 64 and all(np.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["id"] is None}) == 1
    none = pu_quality.train(statistics, labels.where("quality = 0"))
    assert {r["score"] for r in pu_quality.scores(statistics, none).collect()} == {0.5}
    empty = pu_quality.with_statistics(docs.limit(0))
    assert pu_quality.scores(empty, pu_quality.train(empty, labels)).collect() == []


def test_labels_of_zero_and_held_out_rows_are_not_learnt_from(spark):
    texts = [f"Some words of number {k} and more of them." for k in range(40)] + ["!! !! !!"] * 20
    statistics = pu_quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    labels = [(k, 1) for k in range(30)]
    fit = lambda more: pu_quality.train(statistics, spark.createDataFrame(labels + more, "doc_id long, quality int"), held_out=F.col("id") % 4 == 2).w
    assert np.array_equal(fit([]), fit([(k, 0) for k in range(30, 60)]))
    assert np.array_equal(fit([]), fit([(k, 0) for k in range(2, 30, 4)]))


def test_the_sample_is_the_first_by_hash(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), F.array(*(F.col("id").cast("float") for _ in STATISTICS)).alias("x"))
    first = [r["x"][0] for r in rows.orderBy("h").limit(700).collect()]
    assert pu_quality._sample(rows, 700)[:, 0].tolist() == first
