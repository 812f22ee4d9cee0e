"""Categories of many values, boosting that stops, resumable runs, metadata rows by position, and doubled products."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basketry.operators import clean, models
from basketry.plans import benchmark
from basketry.sources import adapter, delimited, sinks


@pytest.fixture(scope="module")
def many(spark):
    """2,000 values of a category, half of which order more often."""
    rng = np.random.default_rng(2)
    values = rng.zipf(1.3, 9000) % 2000
    made = [(k, f"v{v:04}" if k % 50 else None, float(rng.normal()), int(rng.random() < (0.9 if v % 2 else 0.1))) for k, v in enumerate(values.tolist())]
    made += [(10_000 + k, f"v{k:04}", 0.0, k % 2) for k in range(2000)]
    return spark.createDataFrame(made, "lineID long, c string, x double, `order` int").persist()


def test_codes_of_many_values(spark, many):
    got = models.ordered_codes(many, "c", "order").orderBy("code").collect()
    counts = {r["c"] or "MISSING": (r["n"], r["s"]) for r in many.groupBy("c").agg(F.count("*").alias("n"), F.sum("order").alias("s")).collect()}
    assert [r["code"] for r in got] == list(range(models.MOST_CATEGORIES - 1))
    kept = sorted(counts, key=lambda v: (-counts[v][0], v))[: models.MOST_CATEGORIES - 1]
    overall = sum(s for _, s in counts.values()) / sum(n for n, _ in counts.values())
    mean = {v: (counts[v][1] + models.SMOOTHING * overall) / (counts[v][0] + models.SMOOTHING) for v in kept}
    assert [r["value"] for r in got] == sorted(kept, key=lambda v: (round(mean[v], 12), v))
    few = models.ordered_codes(many.where("c in ('v0001', 'v0002')"), "c", "order").collect()
    assert {r["value"]: r["code"] for r in few} == {"v0002": 0, "v0001": 1}


def test_a_category_of_2000_values_fits_the_boosted_model(spark, many):
    model = models.fit_classifier(many, ["c", "x"], "boosted")
    unseen = spark.createDataFrame([(1, "never", 0.0, 1), (2, "other", 0.0, 0), (3, None, 0.0, 1)], many.schema)
    scored = {r["lineID"]: r["score"] for r in models.score_classifier(model, unseen, ["c", "x"], keep=["lineID"]).collect()}
    assert scored[1] == scored[2] and 0 < scored[3] < 1
    own = models.evaluate_classifier(models.score_classifier(model, many, ["c", "x"]))
    assert own["roc_auc"] > 0.8
    curve = models.boosting_curve(model, many, ["c", "x"]).orderBy("round").collect()
    losses = [r["loss"] for r in curve]
    assert 1 <= len(curve) <= models.ROUNDS and [r["last"] for r in curve] == [False] * (len(curve) - 1) + [True] and losses[-1] <= losses[0]
    assert len(curve) == model.stages[-1].getNumTrees
    constant = models.evaluate_classifier(models.baseline(many, many, "mean", "order").withColumnRenamed("prediction", "score"))
    assert own["log_loss"] < constant["log_loss"]


def test_the_rows_that_stop_boosting_are_always_the_same(spark, many):
    once, twice = (sorted(r["lineID"] for r in models.with_validation(df).where(models.VALIDATION).select("lineID").collect()) for df in (many, many.repartition(7)))
    assert once == twice and 0.05 < len(once) / many.count() < 0.15


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, float(k % 7), k % 3 % 2, float(k % 4)) for k in range(60)], "lineID long, price double, `order` int, quantity double").withColumn("qty_suspicious", F.lit(0))
    ledger, worked = f"file://{tmp_path}/ledger", []

    def one(train, evaluation, features, kind, task, target):
        if len(worked) == 2 and not worked.count("broken"):
            worked.append("broken")
            raise KeyboardInterrupt
        worked.append((features[0], kind))
        if kind == "boosted":
            raise ValueError("x" * 1000)
        return {"f1": 0.5}

    monkeypatch.setattr(benchmark, "_one", one)
    run = lambda name="a": benchmark.run(df, df, {"v": ["price"], "w": ["lineID"]}, regressors=(), ledger=ledger, run_name=name)
    with pytest.raises(KeyboardInterrupt):
        run()
    assert {(r["variant"], r["model"]) for r in sinks.RunLedger(spark, ledger, "a", benchmark.COLUMNS, ("task", "variant", "model")).rows().collect()} == {("v", "most_frequent"), ("v", "logistic_balanced")}
    rows = run().collect()
    worked.remove("broken")
    assert len(worked) == len(set(worked)) == len(rows) == 6
    assert {(r["variant"], r["model"], r["status"]) for r in rows} == {(v, m, "failed" if m == "boosted" else "ok") for v in "vw" for m in models.CLASSIFIERS}
    assert all(r["error"] == "x" * 1000 for r in rows if r["status"] == "failed") and len(run().collect()) == 6 and len(worked) == 6
    assert len(run("b").collect()) == 6 and len(worked) == 12


def test_only_the_two_rows_after_the_header_are_metadata(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("p, q\ncontinuous,c\nclass,\n1,2\n,\nc,d\n3,4\n".replace("p, q", "p,q"))
    (tmp_path / "in/b.csv").write_text("p,q\n5,6\nc,d\n7,8\n")
    got = delimited.read_predictions(spark, f"file://{tmp_path}/in")
    assert got.columns == ["p", "q"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1.0, 2.0), (None, None), (None, None), (3.0, 4.0), (5.0, 6.0), (None, None), (7.0, 8.0)], key=str)
    (tmp_path / "c.csv").write_text("p,q\nc,c\n")
    assert delimited.read_predictions(spark, f"file://{tmp_path}/c.csv").count() == 1
    (tmp_path / "d.csv").write_text("﻿p,q\r\nc,c\r\nclass,meta\r\n0.5,\"1\"\r\n")
    assert [tuple(r) for r in delimited.read_predictions(spark, f"file://{tmp_path}/d.csv").collect()] == [(0.5, 1.0)]


def test_a_doubled_product_is_an_error(spark):
    sf = "/root/testdata/sf0.001"
    fact, dim = adapter.fact(spark, sf), adapter.dim(spark, sf)
    assert clean.prepare(fact, dim).count() == fact.count()
    with pytest.raises(PySparkException, match="occurs more than once"):
        clean.prepare(fact, dim.unionByName(dim.limit(1))).select("lineID", "rrp").collect()
