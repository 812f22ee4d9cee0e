"""Sub-models from sums of products against a direct least-squares fit, and the plan of the ablation."""

import numpy as np

from basketry.operators import grams
from basketry.schema import feature_set


def rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    made = [(k, float(a) if rng.random() > 0.1 else None, int(b), "xyz"[c] if rng.random() > 0.1 else None, 1.0, int(a + b / 3 + c / 2 + rng.normal() > 1) if k else None) for k, (a, b, c) in enumerate(zip(rng.normal(size=n), rng.integers(0, 5, n), rng.integers(0, 3, n), strict=True))]
    return spark.createDataFrame(made, "id long, a double, b int, t string, still double, y int")


def encoded(train, df):
    """The columns by pandas."""
    mean = train["y"].mean()
    codes = train.groupby("t")["y"].mean()
    return np.column_stack([(df["a"] - train["a"].mean()).fillna(0), df["b"] - train["b"].mean(), df["t"].map(codes).astype(float).fillna(mean) - mean, df["still"] - 1]), mean


def test_sub_models_equal_direct_fits(spark):
    train, test = rows(spark, 300, 1), rows(spark, 120, 2)
    subsets = {"all": ["a", "b", "t", "still"], "a": ["a"], "b and t": ["b", "t"], "none": []}
    got = grams.subset_models(train, test, subsets, "y", ridge=0.01).toPandas()
    t, v = train.toPandas().dropna(subset=["y"]), test.toPandas().dropna(subset=["y"])
    (x, mean), (z, _) = encoded(t, t), encoded(t, v)
    for name, columns in {"all": [0, 1, 2], "a": [0], "b and t": [1, 2], "none": []}.items():
        gram = x[:, columns].T @ x[:, columns]
        w = np.linalg.solve(gram + 0.01 * np.diag(np.diag(gram)), x[:, columns].T @ (t["y"] - mean)) if columns else np.empty(0)
        own = got[got["model"] == name]
        assert np.allclose(np.sort(own["score"]), np.sort(z[:, columns] @ w + mean)) and sorted(own["y"]) == sorted(v["y"])


def test_the_sums_hold_every_pair(spark):
    got = {(r["a"], r["b"]): r["covariance"] for r in grams.gram(rows(spark, 200, 3), ["a", "b", "t"], "y").collect()}
    t = rows(spark, 200, 3).toPandas()
    t = t.dropna(subset=["y"])
    means = t[["a", "b"]].mean()
    assert len(got) == 10
    assert np.isclose(got["a", "b"], ((t["a"] - means["a"]).fillna(0) * (t["b"] - means["b"])).mean())
    assert np.isclose(got["b", "y"], ((t["b"] - means["b"]) * (t["y"] - t["y"].mean())).mean())


def test_the_plan_of_the_ablation():
    for stage in ("cls", "reg"):
        features = feature_set(f"{stage}_final")
        plan = grams.ablation_subsets(features)
        families = grams.ablation_families()
        assert len(families) == 9 and plan["all", ""] == features
        assert sorted(f for n, fs in families.items() for f in fs if f in features) == sorted(features)
        for name, fs in families.items():
            own = [f for f in features if f in fs]
            assert (("without", name) in plan) == bool(own)
            if own:
                assert set(plan["without", name]) == set(features) - set(own)


def test_the_ablation_finds_the_family_that_counts(spark):
    rng = np.random.default_rng(4)
    made = [(int(d), float(p), int(u), int(p + rng.normal() / 4 > 0)) for d, p, u in zip(rng.integers(1, 30, 600), rng.normal(size=600), rng.integers(0, 2, 600), strict=True)]
    df = spark.createDataFrame(made, "day int, price double, adFlag int, `order` int")
    got = {(r["experiment"], r["family"]): r for r in grams.family_ablation(df.where("day < 20"), df.where("day >= 20"), ["day", "price", "adFlag"], "order", True).collect()}
    assert got["without", "price_absolute"]["roc_auc_delta"] < -0.3 and abs(got["without", "campaign_ad"]["roc_auc_delta"]) < 0.05
    assert got["added", "price_absolute"]["roc_auc_delta"] > 0.3 and got["core", "time"]["roc_auc_delta"] is None
    reg = {(r["experiment"], r["family"]): r for r in grams.family_ablation(df, df, ["day", "price", "adFlag"], "price", False).collect()}
    assert reg["all", ""]["mae"] < 0.01 < 0.5 < reg["without", "price_absolute"]["mae_delta"]
