"""The filter report on odd frames: constants, missing values, texts, no rows; correlations of pairs; families."""

import math

import numpy as np

from basketry.operators import screening


def test_report_of_odd_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), 1, None, "xy"[int(a > 0)] if k % 4 else None, 0 if k else 7, int(a > 0) if k % 10 else None) for k, a in enumerate(rng.normal(size=2000))]
    df = spark.createDataFrame(rows, "price double, adFlag int, rrp double, group12 string, has_campaign int, y int")
    got = {r["feature"]: r for r in screening.filter_report(df, ["price", "adFlag", "rrp", "group12", "has_campaign"], "y").collect()}
    assert [got[c]["kind"] for c in ("price", "adFlag", "group12", "has_campaign")] == ["numeric", "binary", "categorical", "binary"]
    assert got["adFlag"]["notes"] == "CONSTANT" and got["rrp"]["notes"] == "CONSTANT; HIGH_MISSING" and got["has_campaign"]["notes"] == "NEAR_ZERO_VAR" and got["price"]["notes"] == ""
    assert got["rrp"]["missing_rate"] == 1.0 and got["rrp"]["n_unique"] == 0 and got["rrp"]["chi2"] is None and got["rrp"]["mutual_information"] is None
    assert got["group12"]["missing_rate"] == 0.25 and math.isclose(got["group12"]["mutual_information"], math.log(2), abs_tol=0.01) and got["group12"]["spearman"] is None
    assert got["price"]["mutual_information"] > 0.6 and got["price"]["spearman"] > 0.8 and got["adFlag"]["spearman"] is None and got["adFlag"]["mutual_information"] < 1e-9
    assert all(r["n_rows"] == 2000 for r in got.values())
    none = screening.filter_report(df.limit(0), ["price", "group12"], "y").collect()
    assert {(r["feature"], r["n_unique"], r["n_rows"]) for r in none} == {("price", 0, None), ("group12", 0, None)}


def test_correlations_of_pairs(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300) + 1e6
    rows = [(float(x), float(2 * x + rng.normal() / 10) if k % 3 else None, 5.0, int(k % 2)) for k, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int").repartition(5)
    got = {(r["feature_a"], r["feature_b"]): r for r in screening.pair_correlations(df, ["a", "b", "c", "d"]).collect()}
    both = np.array([(x, y) for x, y, *_ in rows if y is not None])
    assert got["a", "b"]["n"] == 200 and math.isclose(got["a", "b"]["r"], np.corrcoef(both.T)[0, 1], rel_tol=1e-9)
    assert got["a", "c"]["r"] is None and got["b", "c"]["r"] is None and abs(got["a", "d"]["r"]) < 0.2 and len(got) == 6
    assert [tuple(r)[:2] for r in screening.redundant_pairs(df, ["a", "b", "c", "d"]).collect()] == [("a", "b")]
    assert screening.redundant_pairs(df.limit(0), ["a", "b"]).collect() == []


def test_assessments(spark):
    report = spark.createDataFrame([("price", "price_absolute", 0.0, 0.01, False), ("rrp", "price_absolute", 0.5, 0.01, True), ("day", "time", 0.0, 0.0, False)], "feature string, family string, missing_rate double, mutual_information double, near_zero_variance boolean")
    pairs = spark.createDataFrame([("price", "rrp", 0.99)], "feature_a string, feature_b string, r double")
    got = {r["family"]: (r["redundant_features"], r["assessment"]) for r in screening.assessed_families(report, pairs).collect()}
    assert got == {"price_absolute": ("price, rrp", "relevant; has redundancy; 1 near-zero variance"), "time": ("", "neutral")}
