"""Queries: joins, rows, features, encodings, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import numeric, text
from basketry.operators import clean, features, history, rollup, segment
from basketry.plans.frames import featured, prepared, train_of
from basketry.plans.registry import query
from basketry.sources import adapter

C = F.col


@query("prep", """SELECT day, split, count(*) AS n_events, avg(click) AS click_rate, avg(basket) AS basket_rate, avg("order") AS order_rate, avg(price) AS mean_price, sum(revenue) AS revenue
FROM prep WHERE split IS NOT NULL GROUP BY day, split""", "click_rate basket_rate order_rate mean_price revenue")
def daily_action_rates(spark, sf):
    df = prepared(spark, sf).where("split is not null")
    return rollup.daily_rates(df).withColumn("split", clean.split_of(C("day")))


@query("f dim", """SELECT metric, value FROM (SELECT (SELECT count(*) FROM f) AS fact_rows, (SELECT count(DISTINCT pid) FROM f) AS fact_keys, (SELECT count(*) FROM dim) AS dim_rows, (SELECT count(DISTINCT pid) FROM dim) AS dim_keys,
  (SELECT count(DISTINCT pid) FROM f WHERE pid NOT IN (SELECT pid FROM dim)) AS fact_orphans, (SELECT count(*) FROM dim WHERE pid NOT IN (SELECT pid FROM f)) AS dim_orphans,
  (SELECT count(*) FROM f LEFT JOIN dim USING (pid)) AS joined_rows, CAST((SELECT count(*) FROM f LEFT JOIN dim USING (pid)) = (SELECT count(*) FROM f) AS BIGINT) AS rows_kept) UNPIVOT (value FOR metric IN (fact_rows, fact_keys, dim_rows, dim_keys, fact_orphans, dim_orphans, joined_rows, rows_kept))""")
def join_quality(spark, sf):
    from basketry.operators.audit import join_quality as report

    return report(adapter.fact(spark, sf), adapter.dim(spark, sf))


@query("", """SELECT count(*) AS n_rows, count(*) FILTER (p.p_partkey IS NULL) AS left_only, CAST(count(p.p_partkey) AS DOUBLE) / count(*) * 100 AS coverage_pct, count(DISTINCT l.l_partkey) AS n_keys
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""", "coverage_pct")
def join_indicator_coverage(spark, sf):
    part = adapter.table(spark, sf, "part").select(C("p_partkey").alias("k"), F.lit(True).alias("marker"))
    joined = adapter.table(spark, sf, "lineitem").select("l_partkey").join(part, C("l_partkey") == C("k"), "left")
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(C("marker").isNull()).alias("left_only"), (F.count("marker") / F.count("*") * 100).alias("coverage_pct"), F.count_distinct("l_partkey").alias("n_keys"))


@query("f dim", "SELECT pid, manufacturer FROM dim WHERE pid NOT IN (SELECT pid FROM f)")
def orphan_dim_keys(spark, sf):
    return adapter.dim(spark, sf).join(adapter.fact(spark, sf).select("pid"), "pid", "left_anti").select("pid", "manufacturer")


@query("f seg", """SELECT "lineID", pid, day FROM f WHERE pid IN (SELECT pid FROM seg WHERE pid_segment = 'Head')""")
def semi_head_rows(spark, sf):
    fact = adapter.fact(spark, sf)
    head = segment.fit_segments(fact.where("day between 26 and 70")).where("pid_segment = 'Head'").select("pid")
    return fact.join(head, "pid", "left_semi").select("lineID", "pid", "day")


@query("f dim", "SELECT pid FROM ((SELECT pid FROM f INTERSECT SELECT pid FROM dim) UNION (SELECT pid FROM dim EXCEPT SELECT pid FROM f WHERE pid % 2 = 0))")
def key_set_operations(spark, sf):
    f, d = adapter.fact(spark, sf).select("pid"), adapter.dim(spark, sf).select("pid")
    return f.intersect(d).union(d.subtract(f.where("pid % 2 = 0"))).distinct()


@query("dimx", 'SELECT pid, "campaignIndex_norm", category_norm, "pharmForm_norm", unit_norm, group_clean, content_clean, has_campaign FROM dimx')
def norm_strings(spark, sf):
    return clean.enrich_dim(adapter.dim(spark, sf)).select("pid", "campaignIndex_norm", "category_norm", "pharmForm_norm", "unit_norm", "group_clean", "content_clean", "has_campaign")


@query("dimx", """SELECT count(DISTINCT "pharmForm") AS raw_forms, count(DISTINCT nullif("pharmForm_norm", 'MISSING')) AS clean_forms, count(DISTINCT unit) AS raw_units, count(DISTINCT unit_norm) AS clean_units,
  count(*) FILTER (regexp_matches(content_clean, '[0-9]+X[0-9]+')) AS multipacks FROM dimx""")
def spellings(spark, sf):
    d = clean.enrich_dim(adapter.dim(spark, sf))
    return d.agg(
        F.count_distinct("pharmForm").alias("raw_forms"), F.count_distinct(F.when(C("pharmForm_norm") != "MISSING", C("pharmForm_norm"))).alias("clean_forms"), F.count_distinct("unit").alias("raw_units"),
        F.count_distinct("unit_norm").alias("clean_units"), F.count_if(C("content_clean").rlike("[0-9]+X[0-9]+")).alias("multipacks"),
    )


@query("dimx", 'SELECT pid, "group", group12, group34 FROM dimx')
def group_parts(spark, sf):
    return clean.enrich_dim(adapter.dim(spark, sf)).select("pid", "group", "group12", "group34")


@query("dimx", "SELECT pid, content, is_multipack, pack_n, pack_size, pack_total_size FROM dimx")
def multipack_general(spark, sf):
    return clean.enrich_dim(adapter.dim(spark, sf)).select("pid", "content", "is_multipack", "pack_n", "pack_size", "pack_total_size")


@query("dim", """SELECT pid, CAST(coalesce(regexp_matches(s, '[0-9]+X[0-9]+'), false) AS INTEGER) AS is_multipack,
  CASE WHEN regexp_matches(s, '[0-9]+X[0-9]+') THEN CAST(list_aggregate(n[:-2], 'product') AS INTEGER) ELSE 1 END AS pack_n, CAST(CASE WHEN regexp_matches(s, '[0-9]+X[0-9]+') THEN n[-1] ELSE n[1] END AS DOUBLE) AS pack_size
FROM (SELECT pid, upper(trim(content)) AS s, list_transform(regexp_extract_all(upper(trim(content)), '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS n FROM dim)""")
def multipack_bi(spark, sf):
    return adapter.dim(spark, sf).withColumn("p", text.pack_integers(C("content"))).select("pid", "p.is_multipack", "p.pack_n", "p.pack_size")


@query("feat", 'SELECT "lineID", day, day_7, day_14, day_30, day % 7 AS day_mod_7 FROM feat')
def day_cycles(spark, sf):
    return features.day_cycles(adapter.fact(spark, sf)).select("lineID", "day", "day_7", "day_14", "day_30", (C("day") % 7).alias("day_mod_7"))


@query("prep", "SELECT week_block, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM prep GROUP BY week_block")
def week_blocks(spark, sf):
    return adapter.fact(spark, sf).groupBy(numeric.week_block(C("day")).alias("week_block")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_PRICE = ("price_diff", "price_discount", "competitorPrice_discount", "price_discount_diff", "is_lower_price", "is_discount", "is_greater_discount")


@query("feat", 'SELECT "lineID", ' + ", ".join(f'"{c}"' for c in _PRICE) + " FROM feat", "price_diff price_discount competitorPrice_discount price_discount_diff")
def price_features(spark, sf):
    return featured(spark, sf).select("lineID", *_PRICE)


@query("feat", 'SELECT "lineID", price_per_unit, rrp_per_unit, "competitorPrice_per_unit" FROM feat', "price_per_unit rrp_per_unit competitorPrice_per_unit")
def per_unit(spark, sf):
    return featured(spark, sf).select("lineID", "price_per_unit", "rrp_per_unit", "competitorPrice_per_unit")


@query("prep", """SELECT "lineID", "competitorPrice" / price AS price_ratio, CASE WHEN rrp > 0 THEN (rrp - price) / rrp END AS discount_vs_rrp FROM prep""", "price_ratio discount_vs_rrp")
def exploration_ratios(spark, sf):
    return prepared(spark, sf).select("lineID", F.try_divide(C("competitorPrice"), C("price")).alias("price_ratio"), F.when(C("rrp") > 0, (C("rrp") - C("price")) / C("rrp")).alias("discount_vs_rrp"))


@query("prep", 'SELECT "lineID", quantity, qty_suspicious FROM prep WHERE "order" = 1', "quantity")
def quantity_derive(spark, sf):
    return prepared(spark, sf).where("`order` = 1").select("lineID", "quantity", "qty_suspicious")


@query("prep", "SELECT quantity_class, count(*) AS n FROM prep GROUP BY quantity_class")
def quantity_class(spark, sf):
    return prepared(spark, sf).groupBy("quantity_class").agg(F.count("*").alias("n"))


@query("f", """SELECT "lineID", CAST(round_even(revenue / price, 0) AS BIGINT) AS quantity, CAST(abs(revenue / price - round_even(revenue / price, 0)) > CAST(0.05 AS DOUBLE) OR round_even(revenue / price, 0) <= 0 AS INTEGER) AS qty_suspicious FROM f WHERE "order" = 1""")
def qty_tolerance(spark, sf):
    q, odd = numeric.rounded_quantity(F.try_divide(C("revenue"), C("price")))
    return adapter.fact(spark, sf).where("`order` = 1").select("lineID", q.alias("quantity"), odd.alias("qty_suspicious"))


@query("f", """SELECT count(*) AS n, avg(CAST(abs(revenue / price - round_even(revenue / price, 0)) < CAST(0.01 AS DOUBLE) AS DOUBLE)) AS near_integer_share,
  avg(CAST(abs(revenue / price - round_even(revenue / price, 0)) < CAST(0.01 AS DOUBLE) AS DOUBLE)) >= CAST(0.95 AS DOUBLE) AS accepted FROM f WHERE "order" = 1""", "near_integer_share")
def near_integer_acceptance(spark, sf):
    raw = F.try_divide(C("revenue"), C("price"))
    near = (F.abs(raw - F.rint(raw)) < 0.01).cast("double")
    return adapter.fact(spark, sf).where("`order` = 1").agg(F.count("*").alias("n"), F.avg(near).alias("near_integer_share"), (F.avg(near) >= 0.95).alias("accepted"))


@query("prep", "SELECT coalesce(split, 'outside') AS split, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM prep) AS share FROM prep GROUP BY ALL", "share")
def chrono_split_counts(spark, sf):
    fact = adapter.fact(spark, sf)
    total = fact.agg(F.count("*").alias("total"))
    g = fact.groupBy(F.coalesce(clean.split_of(C("day")), F.lit("outside")).alias("split")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(total)).select("split", "n", (C("n") / C("total")).alias("share"))


@query("prep", """SELECT split, count(*) AS n_rows, count(*) FILTER ("order" = 1 AND quantity IS NOT NULL AND qty_suspicious = 0) AS n_stage2 FROM prep WHERE split IS NOT NULL GROUP BY split""")
def stage2_mask(spark, sf):
    return prepared(spark, sf).where("split is not null").groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(clean.stage2()).alias("n_stage2"))


@query("seg", "SELECT pid, n_events, pid_segment FROM seg")
def pid_segment(spark, sf):
    return segment.fit_segments(adapter.fact(spark, sf).where("day between 26 and 70"))


@query("daily", "SELECT DISTINCT pid, pid_total_events, pid_segment FROM daily")
def pid_segment_rollup(spark, sf):
    s = segment.fit_segments(adapter.fact(spark, sf), "ceil")
    return s.select("pid", C("n_events").alias("pid_total_events"), "pid_segment")


@query("f", """SELECT pid_segment, count(DISTINCT pid) AS n_keys, count(*) AS n_events, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM f) AS event_share, avg("order") AS order_rate
FROM f JOIN (SELECT pid, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, pid) <= floor(count(*) OVER () * CAST(0.1 AS DOUBLE)) THEN 'Head' WHEN row_number() OVER (ORDER BY count(*) DESC, pid) <= floor(count(*) OVER () * CAST(0.5 AS DOUBLE)) THEN 'Mid' ELSE 'Tail' END AS pid_segment FROM f GROUP BY pid) USING (pid) GROUP BY pid_segment""", "event_share order_rate")
def segment_bands(spark, sf):
    return segment.band_report(adapter.fact(spark, sf))


@query("f", """WITH r AS (SELECT n, row_number() OVER (ORDER BY n DESC, pid) AS rnk, count(*) OVER () AS keys, sum(n) OVER () AS total FROM (SELECT pid, count(*) AS n FROM f GROUP BY pid))
SELECT CAST(sum(n) FILTER (rnk <= greatest(1, floor(keys * CAST(0.01 AS DOUBLE)))) AS DOUBLE) / max(total) AS top_1pct, CAST(sum(n) FILTER (rnk <= greatest(1, floor(keys * CAST(0.1 AS DOUBLE)))) AS DOUBLE) / max(total) AS top_10pct,
  CAST(sum(n) FILTER (rnk > keys - floor(keys * CAST(0.5 AS DOUBLE))) AS DOUBLE) / max(total) AS bottom_50pct FROM r""", "top_1pct top_10pct bottom_50pct")
def concentration(spark, sf):
    return segment.concentration(adapter.fact(spark, sf))


@query("f", """SELECT pid, row_number() OVER w AS rank, n, CAST(sum(n) OVER (ORDER BY n DESC, pid ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER () AS cum_share FROM (SELECT pid, count(*) AS n FROM f GROUP BY pid) WINDOW w AS (ORDER BY n DESC, pid)""", "cum_share")
def pareto(spark, sf):
    return segment.pareto(adapter.fact(spark, sf)).withColumn("rank", C("rank").cast("long"))


_EDGES = "list_distinct(list_transform(quantile_cont({c}, [CAST(k AS DOUBLE) / 20 for k in range(0, 21)]), lambda e: round(e, 9)))"


@query("feat", "SELECT 'price_diff' AS feature, unnest(list_sort(" + _EDGES.format(c="price_diff") + ")) AS edge FROM feat WHERE split = 'train' UNION ALL SELECT 'price_discount', unnest(list_sort(" + _EDGES.format(c="price_discount") + ")) FROM feat WHERE split = 'train'", "edge", 7)
def qcut_edges(spark, sf):
    e = features.fit_edges(train_of(featured(spark, sf)))
    return e.select(F.lit("price_diff").alias("feature"), F.explode("price_diff_edges").alias("edge")).unionByName(e.select(F.lit("price_discount").alias("feature"), F.explode("price_discount_edges").alias("edge")))


@query("feat", f"""WITH e AS (SELECT list_sort({_EDGES.format(c="price_diff")}) AS price_diff, list_sort({_EDGES.format(c="price_discount")}) AS price_discount FROM feat WHERE split = 'train')
SELECT "lineID", CASE WHEN f.price_diff IS NULL THEN 'NO_COMPETITOR_PRICE' ELSE 'Q' || lpad(CAST(len(list_filter(e.price_diff[2:-2], lambda x: x < f.price_diff)) + 1 AS VARCHAR), 2, '0') END AS price_diff_bin,
  CASE WHEN f.price_discount IS NULL THEN 'NO_RRP' ELSE 'Q' || lpad(CAST(len(list_filter(e.price_discount[2:-2], lambda x: x < f.price_discount)) + 1 AS VARCHAR), 2, '0') END AS discount_bin FROM feat f, e WHERE split IS NOT NULL""")
def qcut_apply(spark, sf):
    df = featured(spark, sf).where("split is not null")
    edges = features.fit_edges(train_of(df))
    df = features.apply_edges(df, edges, "price_diff", "price_diff_bin", "NO_COMPETITOR_PRICE")
    return features.apply_edges(df, edges, "price_discount", "discount_bin", "NO_RRP").select("lineID", "price_diff_bin", "discount_bin")


@query("feat", """WITH b AS (SELECT quantile_cont(price_diff, CAST(0.01 AS DOUBLE)) AS lo, quantile_cont(price_diff, CAST(0.99 AS DOUBLE)) AS hi FROM feat),
c AS (SELECT "lineID", CASE WHEN price_diff IS NOT NULL THEN least(greatest(price_diff, lo), hi) END AS c FROM feat, b),
e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(c, [CAST(k AS DOUBLE) / 10 for k in range(0, 11)]), lambda x: round(x, 9)))) AS e FROM c),
p AS (SELECT c.*, e.e, greatest(1, len(list_filter(e.e, lambda x: x < round(c.c, 9)))) AS k FROM c, e)
SELECT "lineID", CASE WHEN c IS NOT NULL THEN format('({:.3f}, {:.3f}]', e[k], e[least(k + 1, len(e))]) END AS price_diff_bin FROM p""")
def clip_qcut(spark, sf):
    return features.clip_and_bin(featured(spark, sf), {"price_diff": "price_diff_bin"}).select("lineID", "price_diff_bin")


@query("feat", """WITH m AS (SELECT min(price) AS lo, max(price) AS hi FROM f) SELECT greatest(1, least(15, CAST(ceil((price - lo) / ((hi - lo) / 15)) AS INTEGER))) AS bin, count(*) AS n, avg("order") AS rate FROM f, m GROUP BY 1""", "rate")
def equal_width_rate(spark, sf):
    return rollup.equal_width_rate(adapter.fact(spark, sf), "price", 15)


@query("prep", """SELECT "lineID", coalesce(freq, CAST(0 AS DOUBLE)) AS manufacturer_freq FROM prep LEFT JOIN (SELECT manufacturer, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS freq FROM prep WHERE split = 'train' AND manufacturer IS NOT NULL GROUP BY manufacturer) USING (manufacturer)""", "manufacturer_freq")
def freq_encode(spark, sf):
    df = prepared(spark, sf)
    return features.frequency_encode(df, train_of(df), "manufacturer", "manufacturer_freq").select("lineID", "manufacturer_freq")


@query("prep", """WITH t AS (SELECT * FROM prep WHERE split = 'train'), o AS (SELECT avg("order") AS m FROM t)
SELECT "lineID", coalesce(a.m, o.m) AS group12_order, coalesce(b.m, o.m) AS group34_order, coalesce(c.m, o.m) AS week_order FROM prep p CROSS JOIN o
LEFT JOIN (SELECT group12, avg("order") AS m FROM t GROUP BY 1) a USING (group12) LEFT JOIN (SELECT group34, avg("order") AS m FROM t GROUP BY 1) b USING (group34) LEFT JOIN (SELECT week_block, avg("order") AS m FROM t GROUP BY 1) c USING (week_block)""", "group12_order group34_order week_order")
def target_encode(spark, sf):
    df = prepared(spark, sf)
    train = train_of(df)
    for column, name in (("group12", "group12_order"), ("group34", "group34_order"), ("week_block", "week_order")):
        df = features.target_encode(df, train, column, "order", name)
    return df.select("lineID", "group12_order", "group34_order", "week_order")


@query("prep", """WITH t AS (SELECT * FROM prep WHERE split = 'train') SELECT "lineID", split, coalesce(m, (SELECT avg("order") FROM t)) AS pid_prob FROM prep LEFT JOIN (SELECT pid, avg("order") AS m FROM t GROUP BY pid) USING (pid) WHERE split IN ('test', 'validation')""", "pid_prob")
def fulltrain_encode(spark, sf):
    df = prepared(spark, sf)
    return features.target_encode(df.where("split in ('test', 'validation')"), train_of(df), "pid", "order", "pid_prob", F.lit(0.5)).select("lineID", "split", "pid_prob")


def _cumulative(frame: str) -> str:
    sums = (("pid_total_events", "1"), ("click_time", "click"), ("basket_time", "basket"), ("order_time", '"order"'))
    cols = ", ".join(f"CAST(coalesce(sum(CASE WHEN day >= 26 THEN {x} ELSE 0 END) OVER w, 0) AS BIGINT) AS {n}" for n, x in sums)
    return f'SELECT "lineID", {cols}, CAST(coalesce(sum(CASE WHEN day >= 26 THEN "order" ELSE 0 END) OVER w, 0) AS BIGINT) AS num_pid_order FROM f WINDOW w AS (PARTITION BY pid {frame})'


_HISTORY = ("lineID", "pid_total_events", "click_time", "basket_time", "order_time", "num_pid_order")


@query("f", _cumulative('ORDER BY day, "lineID" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING'))
def cumulative_history(spark, sf):
    return history.cumulative(adapter.fact(spark, sf)).select(*_HISTORY)


@query("f", _cumulative("ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
def cumulative_strict(spark, sf):
    return history.cumulative(adapter.fact(spark, sf), strict=True).select(*_HISTORY)


def _forward(e: history.Encoding) -> str:
    value = f'"{e.target}"' if e.history is None else f'CASE WHEN "order" = 1 AND quantity IS NOT NULL AND qty_suspicious = 0 THEN {e.target} END'
    return f"""WITH t AS (SELECT *, {value} AS v FROM feat WHERE split = 'train'),
c AS (SELECT {e.group} AS g, week_block AS b, sum(v) AS s, count(v) AS n FROM t GROUP BY ALL), w AS (SELECT week_block AS b, sum(v) AS s, count(v) AS n FROM t GROUP BY ALL),
h AS (SELECT g, b, CAST(sum(s) OVER (PARTITION BY g ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY g ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM c),
a AS (SELECT b, CAST(sum(s) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM w)
SELECT "lineID", coalesce(h.m, a.m, CAST({e.cold_start} AS DOUBLE)) AS {e.name} FROM t LEFT JOIN h ON t.{e.group} = h.g AND t.week_block = h.b LEFT JOIN a ON t.week_block = a.b"""


def _register_forward(e: history.Encoding, name: str) -> None:
    def run(spark, sf):
        train = features.day_cycles(train_of(prepared(spark, sf)))
        return history.forward_encode(train, e).select("lineID", e.name)

    run.__name__ = name
    query("feat", _forward(e), e.name)(run)


for _e, _n in zip(history.ENCODINGS, ("forward_oof_pid", "forward_oof_availability", "forward_oof_day7", "forward_oof_qty"), strict=True):
    _register_forward(_e, _n)


@query("prep", """WITH t AS (SELECT * FROM prep WHERE split = 'train'), b AS (SELECT week_block AS block, count(*) AS n_rows, sum("order") AS s FROM t GROUP BY 1),
g AS (SELECT block, count(*) AS ng FROM (SELECT pid, min(week_block) AS block FROM t GROUP BY pid) GROUP BY block)
SELECT 'pid_prob' AS feature, block, CASE WHEN row_number() OVER (ORDER BY block) = 1 THEN 'cold_start' ELSE 'forward' END AS kind, n_rows,
  CAST(coalesce(sum(n_rows) OVER w, 0) AS BIGINT) AS n_history_rows, CAST(coalesce(sum(coalesce(ng, 0)) OVER w, 0) AS BIGINT) AS n_groups, round(CAST(sum(s) OVER w AS DOUBLE) / sum(n_rows) OVER w, 6) AS history_mean
FROM b LEFT JOIN g USING (block) WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def oof_fold_info(spark, sf):
    return history.fold_info(train_of(prepared(spark, sf)), history.ENCODINGS[0])


@query("prep", """WITH v AS (SELECT "pharmForm_norm" AS k, min("lineID") AS first FROM prep WHERE split = 'train' AND "pharmForm_norm" IS NOT NULL GROUP BY 1), c AS (SELECT k, CAST(row_number() OVER (ORDER BY first, k) - 1 AS DOUBLE) AS code FROM v)
SELECT "lineID", coalesce(code, CAST(-1 AS DOUBLE)) AS code FROM prep LEFT JOIN c ON "pharmForm_norm" = k""")
def ordinal_codes(spark, sf):
    df = prepared(spark, sf)
    return features.lookup(df, features.ordinal_by_appearance(train_of(df), "pharmForm_norm"), "pharmForm_norm", "code", F.lit(-1.0)).select("lineID", "code")


@query("prep", """WITH c AS (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT group12 AS k FROM prep WHERE split = 'train' AND group12 IS NOT NULL))
SELECT "lineID", coalesce(code, CAST(-1 AS DOUBLE)) AS code FROM prep LEFT JOIN c ON group12 = k""")
def ordinal_codes_sorted(spark, sf):
    df = prepared(spark, sf)
    return features.lookup(df, features.ordinal_sorted(train_of(df), "group12"), "group12", "code", F.lit(-1.0)).select("lineID", "code")


@query("prep", """SELECT "lineID", CASE WHEN group12 IS NULL THEN 'MISSING' WHEN k IS NULL THEN '__UNSEEN__' ELSE group12 END AS group12_aligned FROM prep LEFT JOIN (SELECT DISTINCT group12 AS k FROM prep WHERE split = 'train' AND group12 IS NOT NULL) ON group12 = k""")
def aligned_categories(spark, sf):
    df = prepared(spark, sf)
    return features.aligned_category(df, train_of(df), "group12", "group12_aligned").select("lineID", "group12_aligned")
