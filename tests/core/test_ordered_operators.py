"""History by blocks, nearest-neighbour information, rank correlation and keyed permutations against plain versions, with hot keys and small ranges."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators import clean, history, metrics, models, ordered, permute, screening
from basketry.schema import Config


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 5)


def events(spark, rows=400, hot=0.5):
    rng = np.random.default_rng(8)
    made = [(k, None if rng.random() < 0.02 else int(rng.integers(20, 35)), 1 if rng.random() < hot else int(rng.integers(2, 9)) if rng.random() > 0.05 else None, *(int(x) if rng.random() > 0.05 else None for x in rng.integers(0, 2, 3))) for k in rng.permutation(rows).tolist()]
    return spark.createDataFrame(made, "lineID long, day int, pid long, click int, basket int, `order` int")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_rows", [37, 10_000])
def test_history_by_blocks_equals_one_window(spark, strict, block_rows):
    df = events(spark)
    w = Window.partitionBy("pid").orderBy("day")
    w = w.rangeBetween(Window.unboundedPreceding, -1) if strict else Window.partitionBy("pid").orderBy("day", "lineID").rowsBetween(Window.unboundedPreceding, -1)
    valid = (F.col("day") >= 26).cast("int")
    plain = {n: F.coalesce(F.sum(valid if c is None else valid * F.col(c)).over(w), F.lit(0)) for n, c in history.COUNTERS.items()}
    wanted = df.select("lineID", *(c.alias(n) for n, c in plain.items()))
    got = history.cumulative(df, strict, block_rows=block_rows)
    assert got.columns == [*df.columns, *history.COUNTERS, "num_pid_order"]
    assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_half_of_the_rows_of_one_key_are_no_single_task(spark):
    df = events(spark, 3000).where("day is not null and pid is not null")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = history.cumulative(df, block_rows=100)
        tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("pid") == 1).alias("hot"), F.sum("order_time")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    hot = sum(r["hot"] for r in tasks)
    assert hot > 1200 and max(r["hot"] for r in tasks) < hot / 8 and len(tasks) > 50


def brute_information(x, y, k=3):
    """From the distances of every row to every other."""
    sizes = collections.Counter(y)
    rows = [(a, b) for a, b in zip(x, y, strict=True) if sizes[b] > 1]
    harmonic = lambda n: sum(1 / j for j in range(1, n)) - 0.5772156649015329
    total = 0.0
    for i, (a, b) in enumerate(rows):
        own = sorted(abs(c - a) for j, (c, d) in enumerate(rows) if d == b and j != i)
        near = min(k, len(own))
        d = own[near - 1]
        m = sum(1 for c, _ in rows if (a - d < c < a + d if d > 0 else c == a))
        total += harmonic(near) - harmonic(len(own) + 1) - harmonic(m)
    return max(0.0, harmonic(len(rows)) + total / len(rows))


@pytest.mark.parametrize("block", [3, 50_000])
def test_knn_information_equals_brute_force(spark, monkeypatch, small_ranges, block):
    monkeypatch.setattr(screening, "NEIGHBOUR_BLOCK", block)
    rng = np.random.default_rng(5)
    y = rng.choice([0, 1, 1, 2], 160).tolist() + [9, 7, 7]
    a, b = (rng.normal(size=163) + np.array(y)).tolist(), (rng.integers(0, 6, 163) / 4.0).tolist()
    df = spark.createDataFrame([*zip(a, b, [1.0] * 163, y, strict=True), (None, 2.0, None, None), (float("nan"), None, None, 1)], "a double, b double, c double, y int")
    got = {r["feature"]: r for r in screening.knn_mutual_information(df, ["a", "b", "c"], "y").collect()}
    for name, x in (("a", a), ("b", b), ("c", [1.0] * 163)):
        assert got[name]["n"] == 162 and math.isclose(got[name]["knn_mi"], brute_information(x, y), abs_tol=1e-9)
    assert got["a"]["knn_mi"] > 0.2 and got["c"]["knn_mi"] < 1e-9
    assert screening.knn_mutual_information(df.limit(0), ["a"], "y").collect() == []


def test_digamma(spark):
    x = spark.range(1, 50).select(screening.digamma(F.col("id")).alias("x")).collect()
    assert np.allclose([r["x"] for r in x], [sum(1 / j for j in range(1, n)) - 0.5772156649015329 for n in range(1, 50)], atol=1e-12)


def test_rank_correlation(spark, small_ranges):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 9, 80), rng.integers(0, 3, 80)
    df = spark.createDataFrame([(int(a), -float(a) * 2, int(b), None) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1, None)], "a int, b double, y int, n double")
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    rho = np.corrcoef(rank(x), rank(y))[0, 1]
    got = {r["feature"]: r for r in screening.spearman(df, ["a", "b", "n"], "y").collect()}
    assert got["a"]["n"] == 80 and math.isclose(got["a"]["spearman"], rho) and got["b"]["n"] == 81 and got["n"]["n"] == 0 and got["n"]["spearman"] is None
    assert screening.spearman(df.limit(5), ["b"], "y").first()["spearman"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_places_are_permuted(spark, n):
    keys = F.array(*(F.lit(k).cast("long") for k in permute.round_keys(5)))
    other = F.array(*(F.lit(k).cast("long") for k in permute.round_keys(6)))
    got = spark.range(n).select(permute.permuted(F.col("id"), n, keys).alias("a"), permute.permuted(F.col("id"), n, other).alias("b")).collect()
    assert sorted(r["a"] for r in got) == list(range(n)) and sorted(r["b"] for r in got) == list(range(n))
    if n >= 100:
        assert sum(r["a"] == r["b"] for r in got) < n / 10 and sum(r["a"] == k for k, r in enumerate(got)) < n / 10


def test_every_value_is_dealt_once(spark, small_ranges):
    df = spark.createDataFrame([(k * 3, k % 7 if k % 5 else None, f"t{k % 4}" if k % 6 else None, k / 2) for k in range(60)], "lineID long, a int, b string, c double")
    got = permute.dealt(df, ["a", "b", "c"], repeats=2)
    assert dict(got.dtypes) == {"lineID": "bigint", **{f"{f}__{k}": t for k in (0, 1) for f, t in (("a", "int"), ("b", "string"), ("c", "double"))}}
    rows, own = got.collect(), df.collect()
    assert sorted(r["lineID"] for r in rows) == sorted(r["lineID"] for r in own)
    for k in (0, 1):
        for f in "abc":
            assert collections.Counter(r[f"{f}__{k}"] for r in rows) == collections.Counter(r[f] for r in own)
    assert [r["c__0"] for r in rows] != [r["c__1"] for r in rows]


def test_a_dimension_of_many_rows_is_not_broadcast_however_small_its_files_are(spark, tmp_path):
    dim = spark.range(20_000).select(F.col("id").alias("pid"), *(F.lit("1").alias(c) for c in ("group", "content", "unit", "pharmForm", "campaignIndex")), *(F.lit(1).alias(c) for c in ("manufacturer", "genericProduct", "salesIndex", "category")), F.lit(1.0).alias("rrp"))
    dim.coalesce(1).write.parquet(f"{tmp_path}/dim")
    dim = spark.read.parquet(f"{tmp_path}/dim")
    fact = spark.createDataFrame([(k, 30, k, 0, 1, 1.0, 1, 0, 0, 1.0, 0.0) for k in range(3)], "lineID long, day int, pid long, adFlag int, availability int, competitorPrice double, click int, basket int, order int, price double, revenue double")
    plan = lambda limit: clean.prepare(fact, dim, Config(broadcast_bytes=limit))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(64 << 20)
    assert "BroadcastHashJoin" not in plan(3 << 20)


def test_values_are_dealt_in_runs_without_a_join(spark, monkeypatch):
    """Small blocks and packs give the places of the network, by a plan that has one record for a run and joins nothing."""
    monkeypatch.setattr(permute, "BLOCK_ROWS", 7)
    monkeypatch.setattr(permute, "PACKED_ROWS", 11)
    df = spark.createDataFrame([(k * 3, f"t{k}" if k % 6 else None, k / 2) for k in range(60)], "lineID long, b string, c double").repartition(3)
    got = permute.dealt(df, ["b", "c"], seed=9, stay=["c"])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(got.collect(), key=lambda r: r["lineID"])
    assert [r["c"] for r in rows] == [k / 2 for k in range(60)]
    for j, f in enumerate(("b", "c")):
        keys = permute.round_keys(9000 + j)
        to = permute.places_of(np.arange(60), 60, keys)
        plain = spark.range(60).select(permute.permuted(F.col("id"), 60, F.array(*(F.lit(k).cast("long") for k in keys))).alias("to"))
        assert to.tolist() == [r["to"] for r in plain.collect()]
        assert [rows[p][f"{f}__0"] for p in to] == [(f"t{k}" if k % 6 else None) if f == "b" else k / 2 for k in range(60)]


def test_only_features_that_the_model_uses_are_dealt(spark, monkeypatch):
    df = spark.createDataFrame([(k, k * 37 % 100 / 100, 1.0, int(k * 37 % 100 >= 50)) for k in range(300)], "lineID long, a double, b double, `order` int").coalesce(1)
    model = models.fit_classifier(df, ["b", "a"], "boosted")
    asked, plain = [], permute.dealt
    monkeypatch.setattr(permute, "dealt", lambda df, features, *rest, **named: asked.append(list(features)) or plain(df, features, *rest, **named))
    got = {r["feature"]: r for r in permute.permutation_importance(model, df, ["b", "a"]).collect()}
    assert asked == [["a"]] and got["b"]["auc_loss"] == 0 and got["b"]["auc_loss_std"] == 0 and 0.3 < got["a"]["auc_loss"] < 0.7


def test_rows_are_dealt_to_many_tasks_however_small_they_are(spark, monkeypatch):
    monkeypatch.setattr(permute, "BLOCK_ROWS", 7)
    df = spark.createDataFrame([(k, k / 2) for k in range(200)], "lineID long, c double").repartition(3)
    assert permute.dealt(df, ["c"]).select(F.spark_partition_id().alias("p")).distinct().count() > 10


@pytest.mark.parametrize("kind", ["boosted", "l1"])
def test_a_variant_is_an_exchange_of_places_in_a_vector(spark, monkeypatch, kind):
    """Features are made numbers and assembled before the rows are multiplied; the loss is that of the whole model on rows with dealt features."""
    made = [(k, k * 37 % 100 / 100 if k % 11 else None, "xyz"[k % 3] if k % 5 else None, k % 7 / 7, int(k * 37 % 100 + 30 * (k % 3) + k % 13 >= 80)) for k in range(300)]
    df = spark.createDataFrame(made, "lineID long, a double, t string, c double, `order` int").coalesce(1)
    features, seen, plain = ["a", "t", "c"], [], metrics.roc_auc
    model = models.fit_classifier(df, features, kind)
    monkeypatch.setattr(metrics, "roc_auc", lambda scored, by=(): seen.append(scored) or plain(scored, by))
    got = {r["feature"]: r for r in permute.permutation_importance(model, df, features, repeats=2).collect()}
    above = seen[0]._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "t__" not in above and "a__" not in above
    monkeypatch.undo()
    rows = permute.dealt(df, features, repeats=2, stay=["order", *features])
    area = lambda x: metrics.roc_auc(models.score_classifier(model, x, features)).first()[0]
    base, used = area(df), permute.used_by(model, df, features)
    assert {"a", "t"} <= set(used)
    for f in used:
        losses = [base - area(rows.withColumn(f, F.col(f"{f}__{k}"))) for k in range(2)]
        assert got[f]["auc_loss"] == pytest.approx(np.mean(losses), abs=1e-9) and got[f]["auc_loss_std"] == pytest.approx(np.std(losses), abs=1e-9)
