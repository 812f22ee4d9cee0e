"""Worked examples, restatements in plain Python, and properties."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry import schema
from basketry.functions import numeric, text
from basketry.operators import clean, decide, features, guards, history, metrics, sampling, segment
from basketry.plans import build
from basketry.sources import delimited, sinks

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_feature_sets_have_their_sizes():
    sizes = {n: len(c) for n, c in schema.FEATURE_SETS.items()}
    assert (sizes["cls_expanded_safe"], sizes["cls_base_safe"], sizes["cls_conditional"], sizes["reg_conditional"]) == (35, 33, 12, 11)
    assert (sizes["cls_final"], sizes["reg_final"], sizes["cls_final_no_groups"], sizes["reg_final_no_group34"]) == (28, 26, 26, 25)
    for n, c in schema.FEATURE_SETS.items():
        schema.no_forbidden(c, n[:3])
    with pytest.raises(ValueError):
        schema.no_forbidden(["revenue"], "cls")
    with pytest.raises(KeyError):
        schema.feature_set("nothing")
    with pytest.raises(ValueError):
        schema.same_columns({"a": ["x", "y"], "b": ["y", "x"]})


@pytest.mark.parametrize(("content", "want"), [("80", (0, 1, 80.0, 80.0)), ("10X1", (1, 10, 1.0, 10.0)), ("6X4X200", (1, 24, 200.0, 4800.0)), ("5x10", (1, 5, 10.0, 50.0)), (None, (0, 1, None, None)), ("PAAR", (0, 1, None, None)), ("5X", (0, 1, 5.0, 5.0)), ("5DX2", (0, 1, 2.0, 2.0)), (" 2.5 ", (0, 1, 2.5, 2.5)), ("0.5X3", (1, 1, 3.0, 3.0))])
def test_pack(spark, content, want):
    row = spark.createDataFrame([(content,)], "c string").select(text.pack(F.col("c")).alias("p")).first()["p"]
    assert tuple(row) == want


def test_quantity_rules(spark):
    rows = [(1, 20.0, 10.0), (1, 20.0, 0.0), (0, 0.0, 10.0), (1, 15.0, 10.0)]
    df = spark.createDataFrame(rows, "order int, revenue double, price double")
    q = clean.quantity(F.col("order"), F.col("price"), F.col("revenue"))
    got = df.select(q.alias("q"), clean.qty_suspicious(F.col("order"), q).alias("s")).collect()
    assert [tuple(r) for r in got] == [(2.0, 0), (None, 1), (None, 0), (1.5, 1)]


def test_price_features(spark):
    df = features.price_features(spark.createDataFrame([(9.0, 10.0, 12.0), (9.0, None, 12.0), (9.0, 10.0, 0.0)], "price double, competitorPrice double, rrp double"))
    a, b, c = df.collect()
    assert (a["price_diff"], a["price_discount"], a["is_lower_price"]) == (-1.0, 0.25, 1.0)
    assert (b["price_diff"], b["is_lower_price"], b["is_greater_discount"]) == (None, None, None)
    assert (c["price_discount"], c["is_discount"]) == (None, None)


def test_day_cycles_and_blocks(spark):
    df = spark.createDataFrame([(d,) for d in (1, 7, 8, 25, 26, 32, 33)], "day int")
    got = df.select(numeric.cycle(F.col("day"), 7).alias("c"), numeric.week_block(F.col("day")).alias("b")).collect()
    assert [r["c"] for r in got] == [1, 7, 1, 4, 5, 4, 5]
    assert [r["b"] for r in got] == [math.floor((d - 26) / 7) + 1 for d in (1, 7, 8, 25, 26, 32, 33)]


def test_running_history(spark):
    df = spark.createDataFrame([(1, "A", 30, 0, 0, 1), (2, "A", 31, 1, 0, 0), (3, "A", 40, 0, 0, 1), (4, "A", 40, 1, 0, 0)], "lineID long, pid string, day int, click int, basket int, order int")
    assert [r["order_time"] for r in history.cumulative(df).orderBy("lineID").collect()] == [0, 1, 1, 2]
    assert [r["order_time"] for r in history.cumulative(df, strict=True).orderBy("lineID").collect()] == [0, 1, 1, 1]


def test_forward_encoding_example(spark):
    df = spark.createDataFrame([(1, "A", 26, 1), (2, "B", 28, 0), (3, "A", 33, 0), (4, "C", 35, 0), (5, None, 35, 0)], "lineID long, g string, day int, y int")
    e = history.Encoding("enc", "g", "y", 0.5)
    assert [r["enc"] for r in history.forward_encode(df, e).orderBy("lineID").collect()] == [0.5, 0.5, 1.0, 0.5, 0.5]


def _forward(rows, cold):
    out, blocks = {}, sorted({b for _, _, b, _ in rows})
    for line, g, b, _ in rows:
        past = [(h, y) for _, h, c, y in rows if c < b and y is not None]
        own = [y for h, y in past if h == g and g is not None]
        every = [y for _, y in past]
        out[line] = cold if b == blocks[0] or not every else sum(own) / len(own) if own else sum(every) / len(every)
    return out


@few
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(26, 60), st.sampled_from([0, 1, None])), min_size=1, max_size=30))
def test_forward_encoding_property(spark, drawn):
    rows = [(k, g, d, y) for k, (g, d, y) in enumerate(drawn)]
    df = spark.createDataFrame(rows, "lineID long, g string, day int, y int")
    want = _forward([(k, g, (d - 26) // 7, y) for k, g, d, y in rows], 0.5)
    got = {r["lineID"]: r["enc"] for r in history.forward_encode(df, history.Encoding("enc", "g", "y", 0.5)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_later_blocks_do_not_change_earlier_codes(spark):
    df = spark.range(200).select(F.col("id").alias("lineID"), (F.col("id") % 5).alias("g"), (26 + F.col("id") % 40).cast("int").alias("day"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    e = history.Encoding("enc", "g", "y", 0.5)
    before = {r["lineID"]: r["enc"] for r in history.forward_encode(df, e).where("day < 47").collect()}
    after = {r["lineID"]: r["enc"] for r in history.forward_encode(df.withColumn("y", F.when(F.col("day") >= 47, 1 - F.col("y")).otherwise(F.col("y"))), e).where("day < 47").collect()}
    assert before == after


@few
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_stratum_sizes(spark, strata):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(strata)], "lineID long, s int")
    got = {r["s"]: r["count"] for r in sampling.stratified(df, ["s"], 0.3).groupBy("s").count().collect()}
    for s in set(strata):
        n = strata.count(s)
        assert got[s] == (n if n <= 2 else max(1, round(n * 0.3)))


def test_class_stratified_has_the_exact_size(spark):
    df = spark.range(100).select(F.col("id").alias("lineID"), (F.col("id") % 3 == 0).cast("int").alias("order"))
    assert sampling.class_stratified(df, "order", 31).count() == 31
    assert sampling.class_stratified(df, "order", 500).count() == 100


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=2, max_size=40))
def test_ranking_metrics(spark, drawn):
    df = spark.createDataFrame([(y, s / 8) for y, s in drawn], "y int, score double")
    pos, neg = [s for y, s in drawn if y], [s for y, s in drawn if not y]
    auc = metrics.roc_auc(df).first()[0]
    if not pos or not neg:
        assert auc is None
    else:
        assert abs(auc - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))) < 1e-12
    if pos:
        want = sum(sum(1 for p in pos if p == t) / len(pos) * sum(1 for p in pos if p >= t) / sum(1 for _, s in drawn if s >= t) for t in set(s for _, s in drawn))
        assert abs(metrics.average_precision(df).first()[0] - want) < 1e-12


def test_grid_has_76_thresholds_and_agrees_with_single_counts(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 97 / 96).alias("score"))
    grid = {round(r["threshold"], 2): r for r in metrics.threshold_grid(df).collect()}
    assert len(grid) == 76
    one = metrics.confusion(df, 0.22).first()
    assert (grid[0.22]["tp"], grid[0.22]["fp"], grid[0.22]["f1"]) == (one["tp"], one["fp"], one["f1"])


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 21)] + [(None,)], "x double")
    edges = df.agg(numeric.quantile_edges(F.col("x"), 4).alias("x_edges"))
    got = [r["b"] for r in features.apply_edges(df, edges, "x", "b", "NONE").orderBy(F.asc_nulls_last("x")).collect()]
    assert got[0] == "Q01" and got[19] == "Q04" and got[20] == "NONE" and len(set(got)) == 5


def test_segments_cover_all_keys(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([1] * 9 + [2] * 3 + [3, 4])], "lineID long, pid long")
    assert {r["pid"]: r["pid_segment"] for r in segment.fit_segments(df).collect()} == {1: "Head", 2: "Mid", 3: "Tail", 4: "Tail"}


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("lineID|day|pid|adFlag|availability|competitorPrice|click|basket|order|price|revenue\n1|26|7|0|1||0|0|1|9.5|19.0\n")
    assert delimited.detect_separator(spark, str(p)) == "|"
    row = delimited.read_fact(spark, str(p)).first()
    assert (row["competitorPrice"], row["revenue"]) == (None, 19.0)
    with pytest.raises(FileNotFoundError):
        delimited.read_fact(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        delimited.read_dim(spark, str(p))
    p2 = tmp_path / "pred.csv"
    p2.write_text("quantity,model a\ncontinuous,continuous\nclass,meta\n1,0.5\n2,1.5\n")
    assert [tuple(r) for r in delimited.read_predictions(spark, str(p2)).collect()] == [(1.0, 0.5), (2.0, 1.5)]
    assert delimited.resolve_column(["quantity", "Model-A"], "model a") == "Model-A"
    with pytest.raises(ValueError):
        delimited.resolve_column(["a1", "a2"], "a")


def test_text_and_json_sinks(spark, tmp_path):
    sinks.save_json(spark, {"a": [1, 2]}, str(tmp_path / "x.json"))
    assert '"a"' in (tmp_path / "x.json").read_text()


def test_build(spark, tmp_path):
    from basketry.sources import adapter

    out = str(tmp_path / "out")
    counts = build.run(adapter.fact(spark, "/root/testdata/sf0.001"), adapter.dim(spark, "/root/testdata/sf0.001"), out, "safe_plus_conditional")
    assert set(counts) == {"train", "test", "validation"}
    assert spark.read.parquet(f"{out}/matrices/cls_base_safe_train_X.parquet").count() == counts["train"]
    assert len(spark.read.parquet(f"{out}/matrices/cls_final_test_X.parquet").columns) == 28
    assert (tmp_path / "out" / "RUN_MANIFEST.md").exists() and delimited.variants(spark, f"{out}/matrices", "cls")
    assert delimited.evaluation_split(spark, f"{out}/matrices", "cls", "base_safe") == "validation"
    manifest = spark.read.option("header", True).csv(f"{out}/exports/manifest.csv")
    assert (manifest.count(), len(manifest.columns), manifest.where("sampling_used = 'true'").count()) == (14, 13, 2)
    again = delimited.load_exports(spark, {s: f"{out}/exports/cls_{s}.csv" for s in ("train", "test")}, "order")
    assert again.count() == counts["train"] + counts["test"] and again.columns[-2:] == ["order", "split"]
    # Later rows get from the stored artefacts what the build gave them.
    stored = build.load_artefacts(spark, f"{out}/metadata/artefacts")
    new = ["price_diff_bin", "discount_bin", "pid_segment", "manufacturer_freq"]
    first = build.apply(spark.read.parquet(f"{out}/staging/base.parquet"), stored).select("lineID", *new)
    built = spark.read.parquet(f"{out}/featured").select("lineID", *new)
    assert first.exceptAll(built).count() == 0 and first.count() == built.count()
    with pytest.raises(ValueError, match="product table"):
        dim = adapter.dim(spark, "/root/testdata/sf0.001")
        build.run(adapter.fact(spark, "/root/testdata/sf0.001"), dim.unionByName(dim.limit(1)), out)


def test_guards(spark):
    df = spark.createDataFrame([(1, "1", 0.5, 0.5), (0, "x", 0.2, 0.9), (None, None, 1.5, -0.5)], "y int, t string, p double, q double")
    assert guards.binary_target(df, "y").first()["valid"] is False and guards.binary_target(df.dropna(), "y").first()["valid"] is True
    assert [guards.probability_pairs(df, "p", "q").first()[c] for c in ("n_outside", "n_off_sum")] == [1, 1]
    assert [r[0] for r in df.select(guards.number_or(F.col("t"), -1.0)).collect()] == [1.0, -1.0, -1.0]
    with pytest.raises(Exception, match="not a number: x"):
        df.select(guards.strict_number(F.col("t"))).collect()
    assert [r[0] for r in df.where("t is null or t = '1'").select(guards.strict_number(F.col("t"))).collect()] == [1.0, None]
    with pytest.raises(ValueError, match="keys"):
        guards.require_valid(guards.unique_key(df.unionByName(df), "t"), "keys")
    guards.require_valid(guards.unique_key(df.where("t is not null"), "t"), "keys")
    none = df.limit(0)
    assert guards.binary_target(none, "y").first()["valid"] is False and guards.unique_key(none, "t").first()["valid"] is True
    # Figures that one side lacks are not valid.
    a, b = spark.createDataFrame([("m", 1.0)], "model string, f1 double"), spark.createDataFrame([("m", 1.0), ("n", 0.5)], "model string, f1 double")
    assert [r["valid"] for r in guards.pinned(a, b, ["model"], ["f1"]).orderBy("model").collect()] == [True, False]


def test_decisions(spark):
    errors = lambda mae, rmse: spark.createDataFrame([("one", "baseline", 1.0, 2.0), ("m", "model", mae, rmse)], "model string, kind string, mae double, rmse double")
    got = [decide.recommend(errors(*x), "one").first()["recommended"] for x in ((1.1, 1.0), (1.03, 1.9), (1.03, 1.96), (1.0, 1.96), (0.9, 1.98))]
    assert got == ["one", "m", "one", "m", "one"]
    run = decide.sample_run(spark.range(10), spark.range(20), 10, 21).first()
    assert (run["n_test"], run["n_events"], run["is_sample"]) == (10, 20, True)
    table = [("m", "v0", s, 0.5, 0.5, 0.5, 0.5) for s in ("test", "val")] + [("m", "v1", "test", 0.51, 0.5, 0.5, 0.5), ("m", "v1", "val", 0.49, 0.5, 0.5, 0.5), ("m", "v2", "test", 0.503, 0.5, 0.5, 0.5), ("m", "v2", "val", 0.5, 0.5, 0.5, 0.5)]
    deltas = decide.variant_deltas(spark.createDataFrame(table, "model string, variant string, split string, f1 double, pr_auc double, precision double, recall double"), "v0", ["f1", "pr_auc", "precision", "recall"])
    of = lambda least, primary="m": decide.overall_decision(deltas, decide.sample_run(spark.range(10), spark.range(20), least, 1), primary, "v0").first()
    assert (of(1)["decision"], of(1)["winner"]) == ("keep as challenger", "v2")
    assert (of(11)["decision"], of(11)["winner"]) == ("sample run, no decision", None)
    assert of(1, "other")["decision"] == "primary model missing, no decision"


def test_registered_benchmarks_take_all_rows(spark, monkeypatch):
    from basketry.plans import benchmark, catalogue_models

    seen = []
    monkeypatch.setattr(benchmark, "run", lambda *args, **options: seen.append(options) or spark.createDataFrame([], benchmark.COLUMNS))
    for q in (catalogue_models.models_cls, catalogue_models.models_reg):
        q(spark, "/root/testdata/sf0.001")
    assert [(x.get("cap_train", 0), x.get("cap_eval", 0)) for x in seen] == [(None, None)] * 2


def test_markdown_table_does_not_cut(spark):
    from basketry.sources import sinks

    assert sinks.markdown_table(spark.range(3), limit=3).count("\n") == 4
    with pytest.raises(ValueError, match="at most 3 rows"):
        sinks.markdown_table(spark.range(4), limit=3)


def test_embedded_selection_has_every_surveyed_model(spark):
    from basketry.plans import catalogue_models

    models = {r["model"] for r in catalogue_models.embedded_selection(spark, "/root/testdata/sf0.001").select("model").distinct().collect()}
    assert models == {"l1", "elastic_net", "boosted", "reg_lasso", "reg_elastic_net", "reg_boosted"}
