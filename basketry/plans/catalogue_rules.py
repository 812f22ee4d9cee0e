"""Queries: guards, target reports and decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import numeric, text
from basketry.operators import audit, clean, decide, guards, metrics, screening
from basketry.plans.frames import featured, grid, predicted, prepared, scored, split_grid
from basketry.plans.registry import query
from basketry.schema import DROPPED, FAMILIES, FEATURE_SETS, PRUNED
from basketry.sources import adapter

C = F.col
_METRICS = "accuracy precision recall f1 mcc"


@query("prep", """SELECT split, count(*) AS n_rows, count(*) FILTER ("order" IS NULL) AS n_missing, count(*) FILTER ("order" = 0) AS n_zero, count(*) FILTER ("order" = 1) AS n_one, count(*) FILTER ("order" NOT IN (0, 1)) AS n_other,
  count(*) = count(*) FILTER ("order" IN (0, 1)) AND min("order") = 0 AND max("order") = 1 AS valid FROM prep GROUP BY split""")
def binary_target(spark, sf):
    return guards.binary_target(prepared(spark, sf), "order", ["split"])


@query("prep", """SELECT split, count(*) AS n_rows, count(*) FILTER (quantity IS NULL) AS n_missing, count(*) FILTER (quantity < 1) AS n_below, count(*) FILTER (quantity >= 1) = count(*) AS valid FROM prep WHERE "order" = 1 GROUP BY split""")
def quantity_target(spark, sf):
    return guards.at_least(prepared(spark, sf).where("`order` = 1"), "quantity", 1.0, ["split"])


@query("models", """SELECT *, n_missing + n_outside + n_off_sum = 0 AS valid FROM (SELECT model, count(*) AS n_rows, count(*) FILTER (score IS NULL OR negative IS NULL) AS n_missing, count(*) FILTER (score NOT BETWEEN 0 AND 1 OR negative NOT BETWEEN 0 AND 1) AS n_outside,
  count(*) FILTER (abs(score + negative - 1) > CAST(0.000001 AS DOUBLE)) AS n_off_sum FROM (SELECT *, CASE WHEN y = 1 THEN 1 - score ELSE CAST(0.9999 AS DOUBLE) - score END AS negative FROM models) GROUP BY model)""")
def probability_pairs(spark, sf):
    """The second probability of ordinary rows is made too small, so that the guard has something to find."""
    pairs = scored(spark, sf).withColumn("negative", F.when(C("y") == 1, 1 - C("score")).otherwise(0.9999 - C("score")))
    return guards.probability_pairs(pairs, "score", "negative", ["model"])


@query("", """SELECT 'line orders' AS name, count(l_orderkey) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, CAST(0 AS BIGINT) AS n_missing, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS n_double, count(*) = count(DISTINCT l_orderkey) AS valid FROM lineitem
UNION ALL SELECT 'parts', count(*), count(DISTINCT p_partkey), 0, count(*) - count(DISTINCT p_partkey), count(*) = count(DISTINCT p_partkey) FROM part""")
def key_uniqueness(spark, sf):
    of = lambda name, table, key: guards.unique_key(adapter.table(spark, sf, table), key).select(F.lit(name).alias("name"), "*")
    return of("line orders", "lineitem", "l_orderkey").unionByName(of("parts", "part", "p_partkey"))


@query("grid", """SELECT 'incumbent' AS name, count(*) AS n_matches, count(*) = 1 AS valid FROM grid WHERE model = 'chars' AND threshold = CAST(22 AS DOUBLE) / 100 UNION ALL SELECT 'any model', count(*), count(*) = 1 FROM grid WHERE threshold = CAST(22 AS DOUBLE) / 100""")
def incumbent_match(spark, sf):
    g, at = grid(spark, sf), C("threshold") == 0.22
    one = guards.one_match(g, (C("model") == "chars") & at).select(F.lit("incumbent").alias("name"), "*")
    return one.unionByName(guards.one_match(g, at).select(F.lit("any model").alias("name"), "*"))


@query("grid", """WITH c AS (SELECT CAST(count(*) FILTER (score >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (score >= 0.5 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (score < 0.5 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (score < 0.5 AND y = 0) AS DOUBLE) AS tn FROM models WHERE model = 'chars'),
a AS (SELECT 'tp' AS metric, tp AS actual FROM c UNION ALL SELECT 'fp', fp FROM c UNION ALL SELECT 'f1', CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END FROM c
  UNION ALL SELECT 'mcc', CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END FROM c),
e AS (UNPIVOT (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, f1, mcc FROM grid WHERE model = 'chars' AND threshold = CAST(50 AS DOUBLE) / 100) ON tp, fp, f1, mcc INTO NAME metric VALUE expected)
SELECT 'chars' AS model, metric, actual, expected, abs(actual - expected) <= 0.000001 AS valid FROM a JOIN e USING (metric)""", "actual expected")
def pinned_metrics(spark, sf):
    """The confusion counts made from all rows against the row of the grid."""
    actual = metrics.confusion(scored(spark, sf).where("model = 'chars'"), 0.5).withColumn("model", F.lit("chars"))
    return guards.pinned(actual, grid(spark, sf).where("model = 'chars' and threshold = 0.5"), ["model"], ["tp", "fp", "f1", "mcc"])


@query("prep", """SELECT "lineID", CAST(CAST(pid AS VARCHAR) AS DOUBLE) AS pid, coalesce(TRY_CAST(category_norm AS DOUBLE), -1) AS category FROM prep""")
def number_casts(spark, sf):
    return prepared(spark, sf).select("lineID", guards.strict_number(C("pid").cast("string")).alias("pid"), guards.number_or(C("category_norm"), -1.0).alias("category"))


@query("prep", 'SELECT CAST("order" AS BIGINT) AS target, count(*) AS n FROM prep GROUP BY 1')
def target_read(spark, sf):
    return guards.target_of(prepared(spark, sf).select("order", "price"), "cls").groupBy("target").agg(F.count("*").alias("n"))


@query("prep", """SELECT day, round(avg("order"), 6) AS order_rate, round(avg(price), 6) AS mean_price FROM prep GROUP BY day""")
def rounded_rates(spark, sf):
    return guards.round_floats(prepared(spark, sf).groupBy("day").agg(F.avg("order").alias("order_rate"), F.avg("price").alias("mean_price")))


@query("prep feat", """SELECT "lineID", price_diff, "order" FROM feat""", "price_diff")
def aligned_target(spark, sf):
    rows = featured(spark, sf)
    return guards.aligned(rows.select("lineID", "price_diff"), rows.select("lineID", "order"), "lineID")


@query("prep", """SELECT check_name, n_violations, CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (UNPIVOT (SELECT count(*) FILTER ("order" <> 1) AS "order", count(*) FILTER (quantity IS NULL) AS quantity, count(*) FILTER (qty_suspicious <> 0) AS suspicious FROM prep) ON COLUMNS(*) INTO NAME check_name VALUE n_violations)""")
def stage2_guard(spark, sf):
    """The guard of the second stage over all rows, so that it has something to find."""
    return audit.violations(prepared(spark, sf), audit.stage2_checks())


@query("fact dim", """SELECT check_name, n_violations, CASE WHEN check_name = 'idle_products' THEN 'INFO' WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (UNPIVOT (SELECT count(*) FILTER (revenue < 0) AS revenue_not_negative,
 count(*) FILTER (click + basket + "order" <> 1) AS one_action_per_row, count(*) FILTER (price <= 0) AS price_positive, count(*) FILTER ("competitorPrice" <= 0) AS competitor_price_positive, count(*) FILTER ("order" = 0 AND revenue <> 0) AS no_revenue_without_order,
 count(*) FILTER ("order" = 1 AND revenue <= 0) AS revenue_with_order, count(*) FILTER ("adFlag" NOT IN (0, 1)) AS flag_is_binary, count(*) - count(DISTINCT "lineID") AS line_key_unique, (SELECT count(*) - count(DISTINCT pid) FROM dim) AS product_key_unique,
 (SELECT count(DISTINCT pid) FROM fact WHERE pid NOT IN (SELECT pid FROM dim)) AS orphan_events, (SELECT count(*) FROM dim WHERE pid NOT IN (SELECT pid FROM fact)) AS idle_products FROM fact) ON COLUMNS(*) INTO NAME check_name VALUE n_violations)""")
def integrity_table(spark, sf):
    return audit.integrity(adapter.fact_all(adapter.table(spark, sf, "events")), adapter.dim(spark, sf))


@query("f", """SELECT *, CAST(n_near AS DOUBLE) / n_checked AS share_near, CAST(n_near AS DOUBLE) / n_checked >= CAST(0.95 AS DOUBLE) AS accepted FROM (SELECT count(*) FILTER ("order" = 1) AS n_orders, count(*) FILTER ("order" <> 1 AND revenue > 0) AS revenue_without_order, count(*) FILTER ("order" = 1 AND revenue <= 0) AS order_without_revenue,
  count(r) AS n_checked, count(q) AS n_near, min(q) AS q_min, avg(q) AS q_mean, max(q) AS q_max, median(q) AS q_median FROM (SELECT *, CASE WHEN abs(r - round_even(r, 0)) <= CAST(0.01 AS DOUBLE) THEN round_even(r, 0) END AS q FROM (SELECT *, CASE WHEN "order" = 1 AND price > 0 THEN revenue / price END AS r FROM f)))""", "q_mean share_near")
def leakage_audit(spark, sf):
    return audit.leakage(adapter.fact(spark, sf))


@query("f", """SELECT CAST(round_even(r, 0) AS BIGINT) AS quantity, count(*) AS n_orders, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM (SELECT revenue / price AS r FROM f WHERE "order" = 1 AND price > 0) WHERE abs(r - round_even(r, 0)) <= CAST(0.01 AS DOUBLE) GROUP BY 1 ORDER BY n_orders DESC, quantity LIMIT 10""", "share")
def top_quantities(spark, sf):
    return audit.top_quantities(adapter.fact(spark, sf))


@query("stage2", """SELECT split, count(*) AS n, avg(CAST(y = 1 AS INTEGER)) AS share_eq_1, avg(CAST(y > 1 AS INTEGER)) AS share_gt_1, avg(CAST(y >= 3 AS INTEGER)) AS share_ge_3, avg(y) AS mean, min(y) AS min, max(y) AS max, quantile_cont(y, CAST(0.5 AS DOUBLE)) AS median, quantile_cont(y, CAST(0.95 AS DOUBLE)) AS p95, quantile_cont(y, CAST(0.99 AS DOUBLE)) AS p99
FROM stage2 WHERE split IS NOT NULL GROUP BY split""", "share_eq_1 share_gt_1 share_ge_3 mean median p95 p99", 6)
def target_summary(spark, sf):
    return audit.target_summary(prepared(spark, sf).where(clean.stage2()).where("split is not null"), "quantity", "split")


@query("f", """SELECT greatest(1, least(20, CAST(ceil((price - lo) / ((hi - lo) / 20)) AS INTEGER))) AS bin, count(*) AS n, min(price) AS least, max(price) AS most FROM f, (SELECT min(price) AS lo, max(price) AS hi FROM f) WHERE price IS NOT NULL GROUP BY 1""")
def price_histogram(spark, sf):
    return audit.histogram(adapter.fact(spark, sf), "price", 20)


@query("dimx", """SELECT "pharmForm_norm" AS value, dense_rank() OVER (ORDER BY "pharmForm_norm") - 1 AS code FROM (SELECT DISTINCT "pharmForm_norm" FROM dimx WHERE "pharmForm_norm" IS NOT NULL)""")
def category_codes(spark, sf):
    return screening.category_codes(clean.enrich_dim(adapter.dim(spark, sf)), "pharmForm_norm")


@query("dim", """SELECT pid, coalesce(code, -999) AS code FROM dim LEFT JOIN (SELECT category, dense_rank() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM dim WHERE category IS NOT NULL)) USING (category)""")
def category_codes_filled(spark, sf):
    d = adapter.dim(spark, sf)
    codes = screening.category_codes(d, "category")
    return d.join(codes, C("category") == C("value"), "left").select("pid", F.coalesce("code", F.lit(-999)).alias("code"))


@query("dim", 'SELECT manufacturer, pid, category, row_number() OVER (PARTITION BY manufacturer ORDER BY category NULLS LAST, pid) AS place FROM dim')
def nulls_last(spark, sf):
    from pyspark.sql import Window

    return adapter.dim(spark, sf).select("manufacturer", "pid", "category", F.row_number().over(Window.partitionBy("manufacturer").orderBy(F.asc_nulls_last("category"), "pid")).cast("long").alias("place"))


@query("f", "SELECT pid, count(*) AS n FROM f GROUP BY pid ORDER BY n, pid LIMIT 10")
def least_seen_products(spark, sf):
    return adapter.fact(spark, sf).groupBy("pid").agg(F.count("*").alias("n")).orderBy("n", "pid").limit(10)


@query("", " UNION ALL ".join(f"SELECT '{f}' AS feature, '{s}' AS scope, '{w}' AS reason" for f, s, w in DROPPED))
def dropped_features(spark, sf):
    return spark.createDataFrame(DROPPED, "feature string, scope string, reason string")


_ALL = [(f, s, not n.startswith("conditional"), f in FEATURE_SETS[f"{s}_expanded_safe"] + FEATURE_SETS[f"{s}_conditional"]) for n, fs in FAMILIES.items() for f in fs for s in ("cls", "reg")]
_WHY = [(f, s, w) for (w, stages), fs in PRUNED.items() for f in fs for s in stages]


@query("", "WITH a(feature, stage, is_safe, in_stage) AS (VALUES " + ", ".join(f"('{f}', '{s}', {safe}, {own})" for f, s, safe, own in _ALL) + "), w(feature, stage, why) AS (VALUES " + ", ".join(f"('{f}', '{s}', '{w}')" for f, s, w in _WHY) + """),
r AS (SELECT a.*, coalesce(string_agg(why, '; ' ORDER BY why), '') AS drop_reason FROM a LEFT JOIN w USING (feature, stage) GROUP BY ALL)
SELECT feature, stage, in_stage AND drop_reason = '' AND is_safe AS in_safe_pruned, in_stage AND drop_reason = '' AS in_full_pruned, CASE WHEN NOT (in_stage AND drop_reason = '') THEN '' WHEN is_safe THEN 'signal; always available' ELSE 'signal; needs history' END AS keep_reason, drop_reason, contains(drop_reason, 'redundant') AS redundant FROM r""")
def feature_candidates(spark, sf):
    return screening.candidates(spark)


_CORR = ("price", "competitorPrice", "day", "rrp")


@query("prep", "SELECT CASE WHEN feature = 'day' THEN 'time' ELSE 'price_absolute' END AS family, count(*) AS n_features, sum(r) AS total, avg(r) AS mean, max(r) AS most FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, abs(corr("{c}", "order")) AS r FROM prep""" for c in _CORR) + ") GROUP BY 1", "total mean most", 6)
def family_importance(spark, sf):
    one = prepared(spark, sf).agg(*(F.abs(F.corr(c, "order")).alias(c) for c in _CORR))
    return screening.family_importance(audit.rows_of(one, _CORR, "feature", "importance"))


@query("models grid", """SELECT model, round(g.accuracy, 4) AS accuracy, round(g.f1, 4) AS f1, round(g.mcc, 4) AS mcc, round(roc_auc, 4) AS roc_auc, round(ap, 4) AS average_precision, round(log_loss, 4) AS log_loss FROM (SELECT * FROM grid WHERE threshold = CAST(50 AS DOUBLE) / 100) g
JOIN (SELECT model, sum(p * (below + q / CAST(2 AS DOUBLE))) / (sum(p) * sum(q)) AS roc_auc, sum(CAST(above AS DOUBLE) / n * p) / sum(p) AS ap FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER w AS above, sum(p + q) OVER w AS n
  FROM (SELECT model, score, sum(y) AS p, sum(1 - y) AS q FROM models GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY model) USING (model)
JOIN (SELECT model, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss FROM (SELECT model, y, greatest(CAST(1e-15 AS DOUBLE), least(1 - CAST(1e-15 AS DOUBLE), score)) AS p FROM models) GROUP BY model) USING (model)""")
def screening_metrics(spark, sf):
    return metrics.screening_metrics(scored(spark, sf), ["model"])


_BY_QUALITY = 'f1 DESC, mcc DESC, "precision" DESC, recall DESC, {last}, model'
_BEST = f"""SELECT * EXCLUDE (collapsed) FROM (SELECT g.*, coalesce(g."precision" < CAST(0.5 AS DOUBLE) * h."precision" AND g.recall > h.recall, false) AS collapsed FROM {{g}} g LEFT JOIN {{g}} h ON g.model = h.model AND h.threshold = CAST(50 AS DOUBLE) / 100)
QUALIFY row_number() OVER (PARTITION BY model ORDER BY collapsed, {_BY_QUALITY.format(last="abs(threshold - CAST(0.5 AS DOUBLE))")}) = 1"""


@query("scored models grid", f"""WITH b AS ({_BEST.format(g="grid")}), m AS (SELECT 'chars' AS model, doc_id, y, score FROM scored UNION ALL SELECT 'id', doc_id, y, CAST(doc_id % 101 AS DOUBLE) / 100 FROM scored)
SELECT model, doc_id, y, score, CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) AS pred_default, CAST(score >= threshold AS INTEGER) AS pred_best FROM m JOIN b USING (model)""")
def scored_predictions(spark, sf):
    return metrics.with_predictions(scored(spark, sf), decide.best_threshold(grid(spark, sf)))


@query("sgrid", f"""WITH t AS (SELECT * FROM sgrid WHERE split = 'test'), b AS ({_BEST.format(g="t")}), s AS (SELECT DISTINCT model, 'default' AS strategy, CAST(50 AS DOUBLE) / 100 AS threshold FROM t UNION ALL SELECT model, 'best_on_test', threshold FROM b UNION ALL SELECT 'chars', 'fixed', CAST(22 AS DOUBLE) / 100)
SELECT model, strategy, split, threshold, f1, "precision", recall FROM s JOIN sgrid USING (model, threshold)""", "f1 precision recall")
def threshold_strategies(spark, sf):
    g = split_grid(spark, sf)
    of = decide.threshold_strategies(g.where("split = 'test'").drop("split"), {"chars": 0.22})
    return of.join(g, ["model", "threshold"]).select("model", "strategy", "split", "threshold", "f1", "precision", "recall")


@query("grid", f"""SELECT model, threshold, mcc, row_number() OVER (ORDER BY mcc DESC, f1 DESC, "precision" DESC, recall DESC, threshold, model) AS rank FROM grid QUALIFY rank <= 10""", "mcc")
def top_by_mcc(spark, sf):
    order = [F.desc("mcc"), F.desc("f1"), F.desc("precision"), F.desc("recall"), F.asc("threshold"), F.asc("model")]
    return decide.rank(grid(spark, sf), order).where("rank <= 10").select("model", "threshold", "mcc", C("rank").cast("long").alias("rank"))


_ABOVE = f"""SELECT *, "precision" >= CAST(0.34 AS DOUBLE) AND recall >= CAST(0.7 AS DOUBLE) AS meets_floors FROM grid QUALIFY row_number() OVER (PARTITION BY model ORDER BY meets_floors DESC, {_BY_QUALITY.format(last="threshold")}) = 1"""
_CHALLENGER = f"""SELECT b.*, b."precision" < CAST(0.34 AS DOUBLE) OR coalesce((b.f1 > d.f1 OR b.mcc > d.mcc) AND b.recall > d.recall + CAST(0.03 AS DOUBLE) AND b."precision" < d."precision" - CAST(0.03 AS DOUBLE), false) AS precision_collapse FROM ({_ABOVE}) b LEFT JOIN grid d ON b.model = d.model AND d.threshold = CAST(50 AS DOUBLE) / 100"""


@query("grid", f"SELECT model, threshold, f1, mcc, meets_floors, precision_collapse FROM ({_CHALLENGER})", "f1 mcc")
def challenger_threshold(spark, sf):
    return decide.challenger_threshold(grid(spark, sf)).select("model", "threshold", "f1", "mcc", "meets_floors", "precision_collapse")


_AREA = """SELECT model, sum(p * (below + q / CAST(2 AS DOUBLE))) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT model, score, sum(y) AS p, sum(1 - y) AS q FROM models GROUP BY ALL)) GROUP BY model"""
_LOSS = """SELECT model, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS logloss FROM (SELECT model, y, greatest(CAST(1e-15 AS DOUBLE), least(1 - CAST(1e-15 AS DOUBLE), score)) AS p FROM models) GROUP BY model"""


@query("models grid", f"""WITH c AS (SELECT * FROM ({_CHALLENGER}) JOIN ({_AREA}) USING (model) JOIN ({_LOSS}) USING (model)), d AS (SELECT c.*, c.f1 - i.f1 AS delta_f1, c.mcc - i.mcc AS delta_mcc, c.auc - i.auc AS delta_auc, c.logloss - i.logloss AS delta_logloss FROM c, c i WHERE i.model = 'id'),
k AS (SELECT *, concat_ws(',', CASE WHEN NOT delta_f1 > 0 THEN 'f1_better' END, CASE WHEN NOT delta_mcc > 0 THEN 'mcc_better' END, CASE WHEN NOT (delta_auc >= 0 OR delta_auc >= -CAST(0.002 AS DOUBLE) AND delta_f1 >= CAST(0.003 AS DOUBLE) AND delta_mcc >= CAST(0.003 AS DOUBLE)) THEN 'auc' END,
  CASE WHEN NOT delta_logloss <= CAST(0.01 AS DOUBLE) THEN 'logloss' END, CASE WHEN NOT "precision" >= CAST(0.36 AS DOUBLE) THEN 'precision' END, CASE WHEN NOT recall >= CAST(0.7 AS DOUBLE) THEN 'recall' END, CASE WHEN precision_collapse THEN 'no_collapse' END) AS failed_checks FROM d)
SELECT model, delta_f1, delta_mcc, delta_auc, delta_logloss, failed_checks, failed_checks = '' AS replaces, delta_logloss > CAST(0.01 AS DOUBLE) AS critical_logloss FROM k WHERE model <> 'id'""", "delta_f1 delta_mcc delta_auc delta_logloss", 6)
def replacement(spark, sf):
    rows = scored(spark, sf)
    both = decide.challenger_threshold(grid(spark, sf)).join(metrics.roc_auc(rows, ["model"]).withColumnRenamed("roc_auc", "auc"), "model").join(metrics.log_loss(rows, ["model"]).withColumnRenamed("log_loss", "logloss"), "model")
    out = decide.replacement(both.where("model <> 'id'"), both.where("model = 'id'"))
    return out.select("model", "delta_f1", "delta_mcc", "delta_auc", "delta_logloss", "failed_checks", "replaces", "critical_logloss")


@query("regm", """SELECT *, CASE WHEN mae_delta <= CAST(0.05 AS DOUBLE) AND CASE WHEN mae_delta > CAST(0.01 AS DOUBLE) THEN rmse_gain > CAST(0.05 AS DOUBLE) ELSE rmse_gain > CAST(0.03 AS DOUBLE) END THEN best_by_rmse ELSE 'always_1' END AS recommended, rmse_gain > CAST(0.05 AS DOUBLE) AS worth_a_forest
FROM (SELECT arg_min(model, mae) FILTER (kind = 'model') AS best_by_mae, arg_min(model, rmse) FILTER (kind = 'model') AS best_by_rmse, min(mae) FILTER (kind = 'model') - max(mae) FILTER (model = 'always_1') AS mae_delta, max(rmse) FILTER (model = 'always_1') - min(rmse) FILTER (kind = 'model') AS rmse_gain FROM regm)""", "mae_delta rmse_gain", 6)
def quantity_recommendation(spark, sf):
    return decide.recommend(metrics.regression(predicted(spark, sf), ["model", "kind"]), "always_1")


@query("prep", """SELECT model, (SELECT count(*) FROM prep WHERE split = 'train') AS n_rows, model = 'logistic' AND (SELECT count(*) FROM prep WHERE split = 'train') > 1000 AS skipped FROM (VALUES ('logistic'), ('boosting')) m(model)""")
def runnable_models(spark, sf):
    models = spark.createDataFrame([("logistic",), ("boosting",)], "model string")
    return decide.runnable(models, prepared(spark, sf).where("split = 'train'"), ["logistic"], most_rows=1000)


_VARIANTS = {0.5: "v0", 0.4: "v1", 0.3: "v2", 0.22: "v3"}
_NAMES = ("f1", "mcc", "precision", "recall")
_WIDE = "SELECT model, CASE " + " ".join(f"WHEN threshold = CAST({round(t * 100)} AS DOUBLE) / 100 THEN '{v}'" for t, v in _VARIANTS.items()) + " END AS variant, " + ", ".join(f"""max("{m}") FILTER (split = '{s}') AS {s}_{m}""" for m in _NAMES for s in ("test", "val")) + " FROM sgrid GROUP BY ALL HAVING variant IS NOT NULL"
_DELTAS = f"WITH w AS ({_WIDE}) SELECT w.*, " + ", ".join(f"w.{s}_{m} - b.{s}_{m} AS delta_{s}_{m}" for m in _NAMES for s in ("test", "val")) + " FROM w JOIN w b ON w.model = b.model AND b.variant = 'v0'"
_DELTA_COLUMNS = " ".join(f"{d}{s}_{m}" for d in ("", "delta_") for m in _NAMES for s in ("test", "val"))


def _deltas(spark, sf):
    """Thresholds stand for the variants of a feature."""
    name = F.coalesce(*(F.when(C("threshold") == t, v) for t, v in _VARIANTS.items()))
    return decide.variant_deltas(split_grid(spark, sf).withColumn("variant", name).where("variant is not null"), "v0", _NAMES)


@query("sgrid", _DELTAS, _DELTA_COLUMNS)
def variant_deltas(spark, sf):
    return _deltas(spark, sf)


@query("sgrid", f"SELECT model, variant, test_f1, delta_test_f1, delta_val_f1 FROM ({_DELTAS}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY test_f1 DESC, test_precision DESC, test_recall DESC, variant) = 1", "test_f1 delta_test_f1 delta_val_f1")
def best_variants(spark, sf):
    return decide.best_variants(_deltas(spark, sf)).select("model", "variant", "test_f1", "delta_test_f1", "delta_val_f1")


@query("sgrid scored f", f"""WITH o AS (SELECT *, delta_test_f1 >= CAST(0.002 AS DOUBLE) AND delta_val_f1 >= 0 OR delta_test_mcc >= CAST(0.002 AS DOUBLE) AND delta_val_mcc >= 0 AS ok FROM ({_DELTAS}) WHERE model = 'chars' AND variant <> 'v0'),
s AS (SELECT (SELECT count(*) FROM scored WHERE doc_id % 2 = 0) AS n_test, (SELECT count(*) FROM f) AS n_events), d AS (SELECT n_test, n_events, n_test < 10 OR n_events < 100 AS is_sample, (SELECT count(*) FROM o) AS n_variants, (SELECT count(*) FROM o WHERE ok) AS n_qualified FROM s)
SELECT 'chars' AS primary_model, *, CASE WHEN is_sample THEN 'sample run, no decision' WHEN n_qualified > 0 THEN 'keep as challenger' ELSE 'do not adopt' END AS decision,
  CASE WHEN NOT is_sample THEN (SELECT variant FROM o WHERE ok ORDER BY greatest(delta_test_f1, delta_test_mcc) DESC, delta_val_f1 DESC, delta_val_mcc DESC, delta_test_recall DESC LIMIT 1) END AS winner FROM d""")
def overall_decision(spark, sf):
    sizes = decide.sample_run(scored(spark, sf).where("model = 'chars' and doc_id % 2 = 0"), adapter.fact(spark, sf), 10, 100)
    return decide.overall_decision(_deltas(spark, sf), sizes, "chars", "v0", ("f1", "mcc"))


@query("feat", """SELECT "lineID", regexp_replace(CAST(CAST(pid AS DOUBLE) AS VARCHAR), '\\.0$', '') AS code, CAST(round("order" * 100.0, 2) AS DECIMAL(9, 2)) || '%' AS share,
CASE WHEN "competitorPrice" IS NULL THEN NULL ELSE abs(price - "competitorPrice") <= 0.01 + 0.02 * abs("competitorPrice") END AS same_price,
CASE WHEN price_diff < -0.002 THEN 'worse' WHEN price_diff > 0.002 THEN 'better' ELSE 'close' END AS verdict,
CASE WHEN price <= 9 AND price >= 8 THEN 'low' WHEN price <= 10 AND price > 9 THEN 'middle' WHEN price <= 12.5 AND price > 10 THEN 'high' END AS band FROM feat""")
def shown_values(spark, sf):
    """Codes without a decimal part, shares as text, prices that are close, verdicts on a difference, and fixed bands."""
    df = featured(spark, sf)
    return df.select(
        "lineID", text.without_point_zero(C("pid").cast("double").cast("string")).alias("code"), text.percent(C("order").cast("double")).alias("share"),
        numeric.is_close(C("price"), C("competitorPrice"), 0.01, 0.02).alias("same_price"), decide.verdict(C("price_diff")).alias("verdict"), numeric.labelled(C("price"), (8, 9, 10, 12.5), ("low", "middle", "high")).alias("band"),
    )


@query("prep", """SELECT 'safe' AS kind, count(*) AS n_features, avg(score) AS mean_score, arg_max(feature, (score, feature)) AS best_feature FROM (
""" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, abs(corr("{c}", "order")) AS score FROM prep""" for c in ("price", "competitorPrice", "day", "adFlag")) + ")", "mean_score")
def safe_vs_conditional(spark, sf):
    scores = prepared(spark, sf).agg(*(F.abs(F.corr(c, "order")).alias(c) for c in ("price", "competitorPrice", "day", "adFlag")))
    return screening.safe_vs_conditional(scores.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in scores.columns)))))


@query("models", "SELECT model, count(score) AS n, min(score) AS least, avg(score) AS mean, max(score) AS greatest FROM models GROUP BY model", "mean")
def described_scores(spark, sf):
    """How many probabilities each model gave, and their range."""
    return scored(spark, sf).groupBy("model").agg(F.count("score").alias("n"), F.min("score").alias("least"), F.avg("score").alias("mean"), F.max("score").alias("greatest"))
