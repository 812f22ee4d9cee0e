"""Queries: samples, audits, roll-ups, screening, metrics and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import audit, clean, decide, metrics, rollup, sampling, screening, segment
from basketry.plans.frames import featured, grid, predicted, prepared, scored, split_grid, train_of
from basketry.plans.registry import query
from basketry.schema import FEATURE_SETS, family_of
from basketry.sources import adapter

C = F.col
_HASH = '(("lineID" * 2654435761 + 42) % 2147483647)'


def _train_with_segment(spark, sf):
    train = train_of(prepared(spark, sf))
    return segment.apply_segments(train, segment.fit_segments(train))


def _stratified(strata: str, where: str = "true") -> str:
    return f"""SELECT "lineID", {strata} FROM (SELECT p.*, coalesce(s.pid_segment, 'Tail') AS pid_segment, 1 AS one FROM prep p LEFT JOIN seg s USING (pid) WHERE split = 'train' AND {where})
QUALIFY row_number() OVER (PARTITION BY {strata} ORDER BY {_HASH}, "lineID") <= CASE WHEN count(*) OVER (PARTITION BY {strata}) <= 2 THEN count(*) OVER (PARTITION BY {strata}) ELSE greatest(1, CAST(round_even(count(*) OVER (PARTITION BY {strata}) * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) END"""


_STAGE2 = '"order" = 1 AND quantity IS NOT NULL AND qty_suspicious = 0'


@query("prep seg", _stratified('week_block, "order", pid_segment'))
def stratified_cls(spark, sf):
    return sampling.sample_cls(_train_with_segment(spark, sf)).select("lineID", "week_block", "order", "pid_segment")


@query("prep seg", _stratified("week_block, quantity_class, pid_segment", _STAGE2))
def stratified_reg(spark, sf):
    return sampling.sample_reg(_train_with_segment(spark, sf)).select("lineID", "week_block", "quantity_class", "pid_segment")


def _shares(column: str) -> str:
    side = lambda t, n: f'(SELECT CAST({column} AS VARCHAR) AS value, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS {n} FROM {t} GROUP BY 1)'
    a, b = "coalesce(p, CAST(0 AS DOUBLE))", "coalesce(s, CAST(0 AS DOUBLE))"
    return f"""SELECT '{column.strip('"')}' AS feature, coalesce(x.value, y.value) AS value, round_even({a}, 6) AS pop_frac, round_even({b}, 6) AS sample_frac, round_even(abs({a} - {b}), 6) AS abs_diff FROM {side("pop", "p")} x FULL JOIN {side("smp", "s")} y ON x.value IS NOT DISTINCT FROM y.value"""


@query("prep seg", f"""WITH pop AS (SELECT p.*, coalesce(s.pid_segment, 'Tail') AS pid_segment FROM prep p LEFT JOIN seg s USING (pid) WHERE split = 'train'), smp AS (SELECT * FROM pop WHERE "lineID" IN (SELECT "lineID" FROM ({_stratified('week_block, "order", pid_segment')})))
{_shares("pid_segment")} UNION ALL {_shares('"order"')} UNION ALL {_shares("group12")}""")
def sample_audit(spark, sf):
    train = _train_with_segment(spark, sf)
    return sampling.compare(train, sampling.sample_cls(train), ["pid_segment", "order", "group12"])


@query("prep", f"""SELECT "lineID" FROM prep WHERE split = 'train' ORDER BY {_HASH}, "lineID" LIMIT 500""")
def uniform_subset(spark, sf):
    return sampling.uniform(train_of(prepared(spark, sf)), 500).select("lineID")


@query("prep", f"""WITH t AS (SELECT * FROM prep WHERE split = 'train'), c AS (SELECT "order" AS k, count(*) AS n, sum(count(*)) OVER () AS total FROM t GROUP BY 1),
w AS (SELECT k, floor(n * CAST(least(501, total) AS DOUBLE) / total) AS lo, n * CAST(least(501, total) AS DOUBLE) / total AS want, least(501, total) AS rows FROM c),
x AS (SELECT k, lo + CAST(row_number() OVER (ORDER BY want - lo DESC, k) <= rows - sum(lo) OVER () AS INTEGER) AS take FROM w)
SELECT "lineID", "order" FROM (SELECT t.*, row_number() OVER (PARTITION BY "order" ORDER BY {_HASH}, "lineID") AS r FROM t) JOIN x ON "order" = k WHERE r <= take""")
def row_cap(spark, sf):
    return sampling.class_stratified(train_of(prepared(spark, sf)), "order", 501).select("lineID", "order")


@query("f", """SELECT pid, arg_min(price, "lineID") AS price, min("lineID") AS "lineID" FROM f GROUP BY pid""")
def dedup_first(spark, sf):
    return decide.best_per(adapter.fact(spark, sf).select("pid", "price", "lineID"), ["pid"], [F.asc("lineID")])


_MISSING = ("competitorPrice", "price", "manufacturer", "group", "content", "unit", "pharmForm", "category", "campaignIndex", "rrp", "pack_size")


@query("prep", "WITH m AS (SELECT count(*) AS rows, " + ", ".join(f'count(*) FILTER ("{c}" IS NULL) AS "{c}"' for c in _MISSING) + " FROM prep), u AS (UNPIVOT m ON COLUMNS(* EXCLUDE (rows)) INTO NAME column_name VALUE n_missing) SELECT column_name, n_missing, round_even(n_missing * CAST(100 AS DOUBLE) / rows, 4) AS pct_missing FROM u WHERE n_missing > 0")
def missingness(spark, sf):
    return audit.missingness(prepared(spark, sf).select(*_MISSING))


_OUTLIERS = ("l_quantity", "l_extendedprice", "l_discount")


@query("", " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count({c}) FROM lineitem) AS n, q[1] AS q1, q[2] AS median, q[3] AS q3, (SELECT count(*) FROM lineitem WHERE {c} < q[1] - 3 * (q[3] - q[1]) OR {c} > q[3] + 3 * (q[3] - q[1])) AS n_outliers FROM (SELECT quantile_cont({c}, [CAST(0.25 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.75 AS DOUBLE)]) AS q FROM lineitem)" for c in _OUTLIERS), "q1 median q3")
def outliers_iqr(spark, sf):
    return audit.outliers(adapter.table(spark, sf, "lineitem"), _OUTLIERS)


@query("prep", f"""SELECT split, count(*) AS n_rows, avg("order") AS order_rate, count(q) AS qty_n, avg(q) AS qty_mean, median(q) AS qty_median, max(q) AS qty_max FROM (SELECT *, CASE WHEN {_STAGE2} THEN quantity END AS q FROM prep) WHERE split IS NOT NULL GROUP BY split""", "order_rate qty_mean qty_median qty_max")
def target_distribution(spark, sf):
    return audit.target_distribution(prepared(spark, sf))


@query("", """SELECT count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, CAST(0.5 AS DOUBLE)) AS p50, quantile_cont(l_extendedprice, CAST(0.9 AS DOUBLE)) AS p90, quantile_cont(l_extendedprice, CAST(0.99 AS DOUBLE)) AS p99, max(l_extendedprice) AS max FROM lineitem""", "mean std min p50 p90 p99 max", 6)
def describe(spark, sf):
    return audit.describe(adapter.table(spark, sf, "lineitem"), "l_extendedprice")


@query("fact", """SELECT check_name, n_violations, CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (UNPIVOT (SELECT count(*) FILTER (click + basket + "order" <> 1) AS one_action_per_row, count(*) FILTER (price <= 0) AS price_positive, count(*) FILTER ("competitorPrice" <= 0) AS competitor_price_positive,
 count(*) FILTER ("order" = 0 AND revenue <> 0) AS no_revenue_without_order, count(*) FILTER ("order" = 1 AND revenue <= 0) AS revenue_with_order, count(*) FILTER ("adFlag" NOT IN (0, 1)) AS flag_is_binary FROM fact) ON COLUMNS(*) INTO NAME check_name VALUE n_violations)""")
def integrity_checks(spark, sf):
    return audit.violations(adapter.fact_all(adapter.table(spark, sf, "events")), audit.integrity_checks())


_POST = {
    "competitor_price_cleaned": '"competitorPrice" <= 0',
    **{f"{b}_is_binary": f'"{b}" NOT IN (0, 1)' for b in ("click", "basket", "order", "adFlag", "competitorPrice_missing", "qty_suspicious")},
    "missing_flag_agrees": '"competitorPrice_missing" <> CAST("competitorPrice" IS NULL AS INTEGER)',
    **{f"{t}_not_empty": f""""{t}" = ''""" for t in ("campaignIndex_norm", "category_norm", "pharmForm_norm", "unit_norm")},
    "quantity_on_orders_only": '"order" = 0 AND quantity IS NOT NULL',
    "suspicious_on_orders_only": '"order" = 0 AND qty_suspicious <> 0',
}


@query("prep", "SELECT check_name, n_violations, CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (UNPIVOT (SELECT " + ", ".join(f'count(*) FILTER ({c}) AS "{n}"' for n, c in _POST.items()) + " FROM prep) ON COLUMNS(*) INTO NAME check_name VALUE n_violations)")
def preprocessing_checks(spark, sf):
    return audit.violations(prepared(spark, sf), audit.preprocessing_checks())


@query("", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n) - count(*) AS BIGINT) AS n_surplus, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_members FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_keys(spark, sf):
    return audit.duplicates(adapter.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("", "SELECT is_duplicate, count(*) AS n FROM (SELECT CAST(count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS INTEGER) AS is_duplicate FROM lineitem) GROUP BY 1")
def duplicate_members(spark, sf):
    return audit.duplicate_members(adapter.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy("is_duplicate").agg(F.count("*").alias("n"))


_DAY = ("price", "competitorPrice", "adFlag", "availability")


@query("f", "WITH g AS (SELECT " + ", ".join(f'count(DISTINCT "{c}") AS "{c}"' for c in _DAY) + " FROM f GROUP BY day, pid), o AS (SELECT count(*) AS n_groups, " + ", ".join(f'count(*) FILTER ("{c}" > 1) AS "{c}"' for c in _DAY) + ", count(*) FILTER (greatest(" + ", ".join(f'"{c}"' for c in _DAY) + ') > 1) AS "any" FROM g) SELECT column_name, n_groups, n_violations, CAST(n_violations AS DOUBLE) / n_groups AS share FROM (UNPIVOT o ON COLUMNS(* EXCLUDE (n_groups)) INTO NAME column_name VALUE n_violations)', "share")
def intraday_check(spark, sf):
    return audit.intraday(adapter.fact(spark, sf), _DAY)


_DIMENSIONS = ("adFlag", "availability", "genericProduct", "salesIndex", "category", "pharmForm_norm")


@query("prep", " UNION ALL ".join(f"""SELECT '{c}' AS dimension, CAST("{c}" AS VARCHAR) AS value, avg("order") AS rate, count(*) AS n FROM prep WHERE "{c}" IS NOT NULL GROUP BY ALL""" for c in _DIMENSIONS), "rate")
def rate_by_dimension(spark, sf):
    return rollup.rates_by(prepared(spark, sf), _DIMENSIONS)


@query("prep", """SELECT availability, avg("order") FILTER ("adFlag" = 0) AS "0", avg("order") FILTER ("adFlag" = 1) AS "1" FROM prep GROUP BY availability""", "0 1")
def rate_pivot(spark, sf):
    return rollup.pivot_rate(prepared(spark, sf), "availability", "adFlag", [0, 1])


@query("prep", """SELECT 'category' AS dimension, CAST(category AS VARCHAR) AS value, avg("order") AS rate, count(*) AS n FROM prep WHERE category IS NOT NULL GROUP BY ALL HAVING count(*) >= 50 ORDER BY rate DESC, value LIMIT 5""", "rate")
def top_categories(spark, sf):
    return rollup.top(prepared(spark, sf), "category", 50, 5)


_DAILY = ("day", "pid", "n_events", "n_click", "n_basket", "n_order", "price", "availability", "adFlag", "campaignIndex_norm", "has_campaign", "competitorPrice_missing", "price_diff_bin", "discount_bin", "manufacturer", "category_norm", "pharmForm_norm", "genericProduct", "salesIndex", "is_multipack", "pack_n", "pack_size", "rrp", "click_rate", "basket_rate", "order_rate", "pid_total_events", "pid_segment")


@query("daily", "SELECT " + ", ".join(f'"{c}"' for c in _DAILY) + " FROM daily", "price click_rate basket_rate order_rate")
def core_daily(spark, sf):
    return rollup.core_daily(rollup.with_price_bins(prepared(spark, sf))).select(*_DAILY)


@query("daily", """SELECT p."lineID", p.day, p.pid, CAST(round_even(p.revenue / p.price, 0) AS BIGINT) AS quantity, CASE WHEN q <= 0 THEN NULL WHEN q <= 1 THEN '1' WHEN q <= 2 THEN '2' WHEN q <= 3 THEN '3' WHEN q <= 5 THEN '4-5' ELSE '>5' END AS quantity_class, d.pid_segment, d.availability
FROM (SELECT *, round_even(revenue / price, 0) AS q FROM prep WHERE "order" = 1) p LEFT JOIN daily d USING (day, pid)""")
def orders_line(spark, sf):
    # No attribute of an order row is a price bin.
    df = prepared(spark, sf)
    return rollup.order_lines(df, rollup.core_daily(df)).select("lineID", "day", "pid", "quantity", "quantity_class", "pid_segment", "availability")


@query("f", """SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n_ma FROM (SELECT day, count(*) AS n FROM f GROUP BY day)""", "n_ma")
def moving_average(spark, sf):
    return rollup.moving_average(adapter.fact(spark, sf).groupBy("day").agg(F.count("*").alias("n")), "n")


@query("dim", """SELECT 'with_null' AS kind, CAST(category AS VARCHAR) AS value, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM dim GROUP BY ALL UNION ALL SELECT 'without', CAST(category AS VARCHAR), CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () FROM dim WHERE category IS NOT NULL GROUP BY ALL""", "share")
def value_share(spark, sf):
    d = adapter.dim(spark, sf)
    both = [sampling.shares(d, "category", null).select(F.lit(k).alias("kind"), "value", "share") for k, null in (("with_null", True), ("without", False))]
    return both[0].unionByName(both[1])


@query("dim", """SELECT "salesIndex", count(*) FILTER ("genericProduct" = 0) AS "0", count(*) FILTER ("genericProduct" = 1) AS "1" FROM dim GROUP BY 1""")
def crosstab(spark, sf):
    return rollup.crosstab(adapter.dim(spark, sf), "salesIndex", "genericProduct", [0, 1])


#: A mapping for the query: product forms by their last word; fixed values.
_FORMS = (("TIN", "METAL"), ("NICKEL", "METAL"), ("BRASS", "METAL"), ("STEEL", "ALLOY"))


@query("prep", """WITH d AS (SELECT *, CASE WHEN "pharmForm_norm" = 'MISSING' THEN 'MISSING' ELSE string_split("pharmForm_norm", ' ')[-1] END AS form FROM prep WHERE "pharmForm_norm" IS NOT NULL)
SELECT CASE WHEN form = 'MISSING' THEN 'missing' WHEN form IN ('TIN', 'NICKEL', 'BRASS', 'STEEL') THEN 'mapped' ELSE 'unmapped' END AS status, count(*) AS n_events, count(DISTINCT pid) AS n_pids FROM d GROUP BY 1""")
def mapping_coverage(spark, sf):
    df = prepared(spark, sf).where("pharmForm_norm is not null").withColumn("form", F.substring_index("pharmForm_norm", " ", -1))
    mapping = spark.createDataFrame(_FORMS, "form string, form_group string")
    return audit.mapping_coverage(clean.map_category(df, mapping, "form", "form"), "form")


_NUMERIC = ("price", "competitorPrice", "rrp", "price_diff", "price_discount", "competitorPrice_discount")


def _corr(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr("{a}", "{b}") AS r FROM feat WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL"""


@query("feat", "SELECT * FROM (" + " UNION ALL ".join(_corr(a, b) for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]) + ") WHERE abs(r) >= CAST(0.8 AS DOUBLE)", "r", 6)
def redundant_pairs(spark, sf):
    return screening.redundant_pairs(featured(spark, sf), _NUMERIC, 0.8)


_NZV = ("adFlag", "availability", "campaignIndex_norm", "genericProduct", "is_multipack", "pid")


@query("prep", "WITH c AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, CAST("{c}" AS VARCHAR) AS value, count(*) AS n FROM prep WHERE "{c}" IS NOT NULL GROUP BY ALL""" for c in _NZV) + """), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value DESC) AS k FROM c),
s AS (SELECT feature, count(*) AS n_unique, CAST(count(*) AS DOUBLE) / sum(n) AS unique_ratio, CAST(max(n) FILTER (k = 1) AS DOUBLE) / max(n) FILTER (k = 2) AS freq_ratio FROM r GROUP BY feature)
SELECT *, n_unique <= 1 AS is_constant, unique_ratio < CAST(0.01 AS DOUBLE) AND (coalesce(freq_ratio, CAST('inf' AS DOUBLE)) > 19 OR n_unique <= 1) AS is_nzv FROM s""", "unique_ratio freq_ratio")
def near_zero_variance(spark, sf):
    return screening.near_zero_variance(prepared(spark, sf), _NZV)


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE)"


@query("prep", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS n, CASE WHEN count(*) >= 20 THEN corr(rx, ry) END AS spearman FROM (SELECT {_rank("x")} AS rx, {_rank("y")} AS ry FROM (SELECT "{c}" AS x, "order" AS y FROM prep WHERE "{c}" IS NOT NULL))""" for c in ("price", "competitorPrice", "day")), "spearman", 6)
def spearman(spark, sf):
    return screening.spearman(prepared(spark, sf), ["price", "competitorPrice", "day"], "order")


_BINS = """WITH x AS (SELECT price AS x, "order" AS y FROM prep WHERE price IS NOT NULL), e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(x, [CAST(k AS DOUBLE) / 10 for k in range(0, 11)]), lambda v: round(v, 9)))) AS e FROM x),
c AS (SELECT len(list_filter(e.e[2:-2], lambda v: v < x.x)) + 1 AS b, y, count(*) AS o FROM x, e GROUP BY ALL)"""


@query("prep", _BINS + """, r AS (SELECT b, sum(o) AS r FROM c GROUP BY b), k AS (SELECT y, sum(o) AS k FROM c GROUP BY y), n AS (SELECT sum(o) AS n FROM c),
g AS (SELECT coalesce(c.o, 0) AS o, CAST(r.r AS DOUBLE) * k.k / n.n AS ex, n.n AS n FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c USING (b, y))
SELECT 'price' AS feature, CAST(max(n) AS BIGINT) AS n, (SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM k) AS dof, sum(power(o - ex, 2) / ex) AS chi2 FROM g""", "chi2", 6)
def chi_square(spark, sf):
    return screening.chi_square(prepared(spark, sf), "price", "order")


@query("prep", _BINS + """SELECT 'price' AS feature, sum(o / CAST(n AS DOUBLE) * ln(CAST(o AS DOUBLE) * n / (CAST(r AS DOUBLE) * k))) AS binned_mi FROM (SELECT o, sum(o) OVER (PARTITION BY b) AS r, sum(o) OVER (PARTITION BY y) AS k, sum(o) OVER () AS n FROM c)""".replace("SELECT 'price'", " SELECT 'price'"), "binned_mi")
def binned_mi(spark, sf):
    return screening.binned_mutual_information(prepared(spark, sf), "price", "order")


_NUMBERS = (
    "day", "day_7", "day_14", "day_30", "adFlag", "availability", "price", "rrp", "competitorPrice", "competitorPrice_missing", "genericProduct", "salesIndex", "has_campaign",
    "is_multipack", "pack_n", "pack_size", "pack_total_size", "price_diff", "price_discount", "competitorPrice_discount", "price_discount_diff", "is_lower_price", "is_discount",
    "is_greater_discount", "rrp_per_unit", "price_per_unit", "competitorPrice_per_unit",
)


def _digamma(x: str) -> str:
    """Steps up to 60, then the series."""
    up = f"(CAST({x} AS DOUBLE) + 60)"
    return f"(ln({up}) - 1 / (2 * {up}) - 1 / (12 * {up} * {up}) + 1 / (120 * pow({up}, 4)) - 1 / (252 * pow({up}, 6)) - list_sum(list_transform(range(60), lambda j: 1 / (CAST({x} AS DOUBLE) + j))))"


_KNN = f"""WITH x AS (SELECT u.f AS f, u.v AS v, y FROM (SELECT unnest([{", ".join(f"{{'f': '{c}', 'v': CAST(" + '"' + c + '"' + " AS DOUBLE)}" for c in _NUMBERS)}]) AS u, "order" AS y FROM feat) WHERE u.v IS NOT NULL AND y IS NOT NULL),
t AS (SELECT f, y, count(*) AS n_y FROM x GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT f, y, v, n_y, list(v) OVER (PARTITION BY f, y ORDER BY v ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM x JOIN t USING (f, y)),
d AS (SELECT f, y, v, n_y, least(3, n_y - 1) AS k, max(list_sort(list_transform(near, lambda z: abs(z - v)))[least(3, n_y - 1) + 1]) AS d, count(*) AS n FROM e GROUP BY f, y, v, n_y),
g AS (SELECT f, v AS w, sum(n) AS here FROM d GROUP BY ALL),
m AS (SELECT d.f, d.y, d.v, sum(here) AS m FROM d JOIN g ON g.f = d.f AND w > v - d AND w < v + d WHERE d > 0 GROUP BY ALL UNION ALL SELECT d.f, d.y, d.v, here FROM d JOIN g ON g.f = d.f AND w = v WHERE d = 0)
SELECT f AS feature, CAST(sum(n) AS BIGINT) AS n, greatest(0, {_digamma("sum(n)")} + sum(n * ({_digamma("k")} - {_digamma("n_y")} - {_digamma("m")})) / sum(n)) AS knn_mi FROM d JOIN m USING (f, y, v) GROUP BY f"""


@query("feat", _KNN, "knn_mi")
def knn_mi(spark, sf):
    """Nearest-neighbour mutual information of every numeric feature with the order, over all rows."""
    return screening.knn_mutual_information(featured(spark, sf), _NUMBERS, "order")


_WORDS = ("category_norm", "pharmForm_norm", "campaignIndex_norm", "group12", "group34")
_FAMILY = {c: family_of(c) for c in (*_NUMBERS, *_WORDS)}


def _filter_sql() -> str:
    long = ", ".join([*(f"{{'f': '{c}', 'v': CAST(" + f'"{c}"' + " AS DOUBLE), 's': CAST(NULL AS VARCHAR)}" for c in _NUMBERS), *(f"{{'f': '{c}', 'v': CAST(NULL AS DOUBLE), 's': " + f'"{c}"' + "}" for c in _WORDS)])
    families = ", ".join(f"('{c}', '{f}', {str(c in _WORDS).lower()})" for c, f in _FAMILY.items())
    return f"""WITH fam(f, family, is_text) AS (VALUES {families}),
z AS (SELECT u.f AS f, u.v AS v, u.s AS s, y FROM (SELECT unnest([{long}]) AS u, "order" AS y FROM feat)),
a AS (SELECT f, count(*) AS n_rows, count(*) FILTER (v IS NULL AND s IS NULL) AS n_missing FROM z GROUP BY f),
h AS (SELECT f, coalesce(s, CAST(v AS VARCHAR)) AS x, count(*) AS n FROM z WHERE v IS NOT NULL OR s IS NOT NULL GROUP BY ALL),
u AS (SELECT f, count(*) AS n_unique, max(n) AS first, (list_sort(list(n), 'DESC'))[2] AS second FROM h GROUP BY f),
q AS (SELECT f, list_sort(list_distinct(list_transform(quantile_cont(v, [CAST(k AS DOUBLE) / 10 for k in range(0, 11)]), lambda x: round(x, 9)))) AS e FROM z WHERE v IS NOT NULL GROUP BY f),
b AS (SELECT f, CASE WHEN s IS NULL THEN CAST(len(list_filter(e[2:-2], lambda x: x < v)) AS VARCHAR) ELSE s END AS b, y FROM z LEFT JOIN q USING (f) WHERE v IS NOT NULL OR s IS NOT NULL),
o AS (SELECT f, b, y, count(*) AS o FROM b GROUP BY ALL),
g AS (SELECT r.f, r.b, c.y, coalesce(o.o, 0) AS o, CAST(r.r AS DOUBLE) * c.c / n.n AS ex, n.n FROM (SELECT f, b, sum(o) AS r FROM o GROUP BY ALL) r JOIN (SELECT f, y, sum(o) AS c FROM o GROUP BY ALL) c USING (f)
  JOIN (SELECT f, sum(o) AS n FROM o GROUP BY f) n USING (f) LEFT JOIN o ON o.f = r.f AND o.b = r.b AND o.y = c.y),
t AS (SELECT f, max(n) AS n, (count(DISTINCT b) - 1) * (count(DISTINCT y) - 1) AS dof, sum(pow(o - ex, 2) / ex) AS plain, sum(pow(abs(o - ex) - least(0.5, abs(o - ex)), 2) / ex) AS yates, sum(CASE WHEN o > 0 THEN CAST(o AS DOUBLE) / n * ln(o / ex) ELSE 0 END) AS table_mi FROM g GROUP BY f),
rk AS (SELECT f, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY f ORDER BY y) + (count(*) OVER (PARTITION BY f, y) - 1) / 2.0 AS ry FROM z WHERE v IS NOT NULL),
sp AS (SELECT f, CASE WHEN count(*) >= 20 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS spearman FROM rk GROUP BY f),
k AS ({_KNN}),
m AS (SELECT f AS feature, family, is_text, n_rows, CAST(n_missing AS DOUBLE) / n_rows AS missing_rate, coalesce(n_unique, 0) AS n_unique, coalesce(n_unique, 0) <= 1 AS is_constant,
  CAST(coalesce(n_unique, 0) AS DOUBLE) / n_rows < 0.01 AND (second IS NULL OR CAST(first AS DOUBLE) / second > 19 OR coalesce(n_unique, 0) <= 1) AS near_zero_variance,
  CASE WHEN t.n >= 20 AND dof >= 1 THEN CASE WHEN dof = 1 THEN yates ELSE plain END END AS chi2, CASE WHEN is_text THEN greatest(0, table_mi) ELSE knn_mi END AS mutual_information, spearman
  FROM fam JOIN a USING (f) LEFT JOIN u USING (f) LEFT JOIN t USING (f) LEFT JOIN sp USING (f) LEFT JOIN k ON k.feature = f)
SELECT feature, family, CASE WHEN is_text THEN 'categorical' WHEN n_unique <= 2 THEN 'binary' ELSE 'numeric' END AS kind, n_rows, missing_rate, n_unique, is_constant, near_zero_variance, chi2, mutual_information, spearman,
  concat_ws('; ', CASE WHEN is_constant THEN 'CONSTANT' END, CASE WHEN near_zero_variance AND NOT is_constant THEN 'NEAR_ZERO_VAR' END, CASE WHEN missing_rate > 0.5 THEN 'HIGH_MISSING' END) AS notes FROM m"""


@query("feat", _filter_sql(), "missing_rate chi2 mutual_information spearman", 6)
def filter_report(spark, sf):
    """All figures of every safe feature that needs no fit against the order, from one pass."""
    return screening.filter_report(featured(spark, sf), [*_NUMBERS, *_WORDS], "order")


_PAIRS = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr(CASE WHEN \"{b}\" IS NOT NULL THEN CAST(\"{a}\" AS DOUBLE) END, CASE WHEN \"{a}\" IS NOT NULL THEN CAST(\"{b}\" AS DOUBLE) END)}}" for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1 :])


@query("feat", f"""WITH r AS ({_filter_sql()}), p AS (SELECT unnest([{_PAIRS}]) AS u FROM feat), twins AS (SELECT DISTINCT unnest([u.a, u.b]) AS twin FROM p WHERE abs(u.r) >= 0.95 AND NOT isnan(u.r)),
g AS (SELECT family, count(*) AS n_features, avg(missing_rate) AS mean_missing_rate, avg(mutual_information) AS mean_information, count(*) FILTER (near_zero_variance) AS n_flat, coalesce(string_agg(twin, ', ' ORDER BY twin), '') AS redundant_features FROM r LEFT JOIN twins ON twin = feature GROUP BY family)
SELECT *, coalesce(nullif(concat_ws('; ', CASE WHEN mean_information > 0.002 THEN 'relevant' END, CASE WHEN redundant_features <> '' THEN 'has redundancy' END, CASE WHEN n_flat > 0 THEN n_flat || ' near-zero variance' END), ''), 'neutral') AS assessment FROM g""", "mean_missing_rate mean_information", 6)
def assessed_families(spark, sf):
    """What the filter report and the redundant pairs say of each family."""
    df = featured(spark, sf)
    return screening.assessed_families(screening.filter_report(df, [*_NUMBERS, *_WORDS], "order"), screening.redundant_pairs(df, _NUMBERS))


@query("prep", """SELECT CASE WHEN feature IN ('price', 'competitorPrice') THEN 'price_absolute' ELSE 'time' END AS family, count(*) AS n_features, avg(abs(r)) AS mean_score, max(abs(r)) AS max_score, string_agg(feature, ', ' ORDER BY feature) AS features
FROM (""" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, corr(rx, ry) AS r FROM (SELECT {_rank("x")} AS rx, {_rank("y")} AS ry FROM (SELECT "{c}" AS x, "order" AS y FROM prep WHERE "{c}" IS NOT NULL))""" for c in ("price", "competitorPrice", "day")) + ") GROUP BY 1", "mean_score max_score", 6)
def family_report(spark, sf):
    s = screening.spearman(prepared(spark, sf), ["price", "competitorPrice", "day"], "order")
    return screening.family_report(s.select("feature", F.abs("spearman").alias("score")))


@query("feat", "SELECT feature, family, n_unique, kind FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, '{f}' AS family, count(DISTINCT "{c}") AS n_unique, CASE WHEN {t} THEN 'categorical' WHEN count(DISTINCT "{c}") <= 2 THEN 'binary' ELSE 'numeric' END AS kind FROM feat""" for c, f, t in (("price", "price_absolute", "false"), ("adFlag", "campaign_ad", "false"), ("pharmForm_norm", "product_master", "true"), ("is_multipack", "pack_structure", "false"))) + ")")
def feature_kinds(spark, sf):
    return screening.feature_kind(featured(spark, sf), ["price", "adFlag", "pharmForm_norm", "is_multipack"])


@query("", " UNION ALL ".join(f"SELECT '{n}' AS name, {len(c)} AS n_features, '{', '.join(c)}' AS features" for n, c in FEATURE_SETS.items()))
def feature_set_table(spark, sf):
    return spark.createDataFrame([(n, len(c), ", ".join(c)) for n, c in FEATURE_SETS.items()], "name string, n_features int, features string")


@query("prep", """SELECT 'train' AS name, count(*) AS n_rows, 3 AS n_columns, 'order' AS target FROM prep WHERE split = 'train' UNION ALL SELECT 'stage2', count(*), 2, 'quantity' FROM prep WHERE split = 'train' AND """ + _STAGE2)
def matrix_shapes(spark, sf):
    train = train_of(prepared(spark, sf))
    return audit.matrix_shapes({"train": (train.select("price", "day", "adFlag"), "order"), "stage2": (train.where(clean.stage2()).select("price", "day"), "quantity")})


_METRICS = "accuracy precision recall f1 mcc"


@query("grid", 'SELECT model, threshold, tp, fp, fn, tn, accuracy, "precision", recall, f1, mcc FROM grid', _METRICS)
def confusion_grid(spark, sf):
    return grid(spark, sf)


@query("scored", """SELECT tp, fp, fn, tn, CAST(0.5 AS DOUBLE) AS threshold, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy FROM (SELECT count(*) FILTER (score >= CAST(0.5 AS DOUBLE) AND y = 1) AS tp, count(*) FILTER (score >= CAST(0.5 AS DOUBLE) AND y = 0) AS fp, count(*) FILTER (score < CAST(0.5 AS DOUBLE) AND y = 1) AS fn, count(*) FILTER (score < CAST(0.5 AS DOUBLE) AND y = 0) AS tn FROM scored)""", "accuracy")
def confusion_at_half(spark, sf):
    return metrics.confusion(scored(spark, sf).where("model = 'chars'"), 0.5).select("tp", "fp", "fn", "tn", "threshold", "accuracy")


@query("models", """SELECT model, sum(p * (below + q / CAST(2 AS DOUBLE))) / (sum(p) * sum(q)) AS roc_auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT model, score, sum(y) AS p, sum(1 - y) AS q FROM models GROUP BY ALL)) GROUP BY model""", "roc_auc")
def roc_auc(spark, sf):
    return metrics.roc_auc(scored(spark, sf), ["model"])


@query("models", """SELECT model, sum(CAST(tp AS DOUBLE) / n * p) / sum(p) AS average_precision FROM (SELECT *, sum(p) OVER w AS tp, sum(p + q) OVER w AS n FROM (SELECT model, score, sum(y) AS p, sum(1 - y) AS q FROM models GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY model""", "average_precision")
def avg_precision(spark, sf):
    return metrics.average_precision(scored(spark, sf), ["model"])


@query("models", """SELECT model, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss FROM (SELECT model, y, greatest(CAST(1e-15 AS DOUBLE), least(1 - CAST(1e-15 AS DOUBLE), score)) AS p FROM models) GROUP BY model""", "log_loss", 6)
def logloss(spark, sf):
    return metrics.log_loss(scored(spark, sf), ["model"])


_REG = "mse mae median_ae bias r2 mape rmse"


@query("regm", "SELECT * EXCLUDE (kind) FROM regm", _REG, 6)
def reg_metrics(spark, sf):
    return metrics.regression(predicted(spark, sf), ["model"])


@query("predicted", " UNION ALL ".join(f"SELECT model, '{s}' AS segment, count(*) AS n, avg(abs(prediction - y)) AS mae, sqrt(avg(power(prediction - y, 2))) AS rmse FROM predicted WHERE {w} GROUP BY model" for s, w in metrics.SEGMENTS.items()), "mae rmse", 6)
def reg_segments(spark, sf):
    return metrics.regression_segments(predicted(spark, sf), ["model"]).select("model", "segment", "n", "mae", "rmse")


@query("predicted", "SELECT model, min(prediction) AS min, max(prediction) AS max, avg(prediction) AS mean, " + ", ".join(f"count(*) FILTER (prediction {t}) AS n_{n}, CAST(count(*) FILTER (prediction {t}) AS DOUBLE) / count(*) AS share_{n}" for n, t in (("below_0", "< 0"), ("below_1", "< 1"), ("above_10", "> 10"), ("above_30", "> 30"))) + " FROM predicted GROUP BY model", "min max mean share_below_0 share_below_1 share_above_10 share_above_30")
def reg_diagnostics(spark, sf):
    return metrics.diagnostics(predicted(spark, sf), ["model"])


@query("predicted", """SELECT *, CASE WHEN -mae_delta > CAST(1e-12 AS DOUBLE) THEN 'improved' WHEN -mae_delta < -CAST(1e-12 AS DOUBLE) THEN 'worsened' ELSE 'no_change' END AS mae_effect, CASE WHEN -rmse_delta > CAST(1e-12 AS DOUBLE) THEN 'improved' WHEN -rmse_delta < -CAST(1e-12 AS DOUBLE) THEN 'worsened' ELSE 'no_change' END AS rmse_effect
FROM (SELECT *, mae_clipped - mae_raw AS mae_delta, rmse_clipped - rmse_raw AS rmse_delta FROM (SELECT model, avg(abs(prediction - y)) AS mae_raw, avg(abs(greatest(prediction, 1) - y)) AS mae_clipped, sqrt(avg(power(prediction - y, 2))) AS rmse_raw, sqrt(avg(power(greatest(prediction, 1) - y, 2))) AS rmse_clipped FROM predicted GROUP BY model))""", "mae_raw mae_clipped rmse_raw rmse_clipped mae_delta rmse_delta", 6)
def clip_effect(spark, sf):
    return metrics.clip_effect(predicted(spark, sf))


_GRID = "model, threshold, tp, fp, fn, tn, accuracy, precision, recall, f1, mcc".split(", ")
_BY_QUALITY = 'f1 DESC, mcc DESC, "precision" DESC, recall DESC, {last}, model'


@query("grid", f"""WITH g AS (SELECT g.*, coalesce(g."precision" < CAST(0.5 AS DOUBLE) * h."precision" AND g.recall > h.recall, false) AS collapsed FROM grid g LEFT JOIN grid h ON g.model = h.model AND h.threshold = CAST(50 AS DOUBLE) / 100)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY model ORDER BY collapsed, {_BY_QUALITY.format(last="abs(threshold - CAST(0.5 AS DOUBLE))")}) = 1""", _METRICS)
def best_threshold(spark, sf):
    return decide.best_threshold(grid(spark, sf)).select(*_GRID, "collapsed")


@query("grid", f"""SELECT *, "precision" >= CAST(0.34 AS DOUBLE) AND recall >= CAST(0.7 AS DOUBLE) AS meets_floors FROM grid QUALIFY row_number() OVER (PARTITION BY model ORDER BY meets_floors DESC, {_BY_QUALITY.format(last="threshold")}) = 1""", _METRICS)
def best_above_floors(spark, sf):
    return decide.best_above_floors(grid(spark, sf)).select(*_GRID, "meets_floors")


@query("grid", f"""SELECT model, threshold, f1, row_number() OVER (ORDER BY {_BY_QUALITY.format(last="abs(threshold - CAST(0.5 AS DOUBLE))")}) AS rank FROM grid QUALIFY rank <= 10""", "f1")
def top_by_f1(spark, sf):
    return decide.rank(grid(spark, sf), decide.quality_order()).where("rank <= 10").select("model", "threshold", "f1", C("rank").cast("long").alias("rank"))


@query("regm", """SELECT model, kind, mae, rmse, rank() OVER (ORDER BY round(mae, 9)) AS mae_rank_all, rank() OVER (ORDER BY round(rmse, 9)) AS rmse_rank_all, rank() OVER (PARTITION BY kind ORDER BY round(mae, 9)) AS mae_rank_kind, rank() OVER (PARTITION BY kind ORDER BY round(rmse, 9)) AS rmse_rank_kind FROM regm""", "mae rmse", 6)
def rank_candidates(spark, sf):
    m = metrics.regression(predicted(spark, sf), ["model", "kind"]).select("model", "kind", F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"))
    return decide.rank_candidates(m)


@query("grid", """SELECT model, threshold, f1, recall, concat_ws(',', CASE WHEN NOT f1 >= CAST(0.5 AS DOUBLE) THEN 'f1' END, CASE WHEN NOT recall >= CAST(0.7 AS DOUBLE) THEN 'recall' END, CASE WHEN NOT mcc >= CAST(0.05 AS DOUBLE) THEN 'mcc' END) AS failed_checks,
  f1 >= CAST(0.5 AS DOUBLE) AND recall >= CAST(0.7 AS DOUBLE) AND mcc >= CAST(0.05 AS DOUBLE) AS passed FROM grid""", "f1 recall")
def challenger_gate(spark, sf):
    return decide.gate(grid(spark, sf), {"f1": 0.5, "recall": 0.7, "mcc": 0.05}).select("model", "threshold", "f1", "recall", "failed_checks", "passed")


@query("regm", """SELECT r.model, r.mae, r.rmse, r.mae - b.mae AS delta_mae, r.rmse - b.rmse AS delta_rmse FROM regm r, regm b WHERE b.model = 'always_1'""", "mae rmse delta_mae delta_rmse", 6)
def against_baseline(spark, sf):
    return decide.against_baseline(metrics.regression(predicted(spark, sf), ["model"]).select("model", "mae", "rmse"), "always_1", ["mae", "rmse"])


@query("sgrid", """SELECT model, a.f1 AS test_f1, b.f1 AS val_f1, b.f1 - a.f1 AS delta_f1, abs(b.f1 - a.f1) < CAST(0.05 AS DOUBLE) AS stable FROM sgrid a JOIN sgrid b USING (model, threshold) WHERE a.split = 'test' AND b.split = 'val' AND threshold = CAST(50 AS DOUBLE) / 100""", "test_f1 val_f1 delta_f1")
def split_stability(spark, sf):
    g = split_grid(spark, sf).where("threshold = 0.5")
    return decide.stability(g.where("split = 'test'"), g.where("split = 'val'"), ["f1"])


@query("grid", """SELECT *, delta_test >= CAST(0.002 AS DOUBLE) AND delta_validation >= 0 AS accepted, (delta_test >= CAST(0.002 AS DOUBLE) AND delta_validation >= 0) AND row_number() OVER (ORDER BY delta_test >= CAST(0.002 AS DOUBLE) AND delta_validation >= 0 DESC, delta_test DESC, variant) = 1 AS chosen
FROM (SELECT model || ' ' || CAST(CAST(round(threshold * 100) AS INTEGER) AS VARCHAR) AS variant, round(f1 - CAST(0.4 AS DOUBLE), 6) AS delta_test, round(mcc, 6) AS delta_validation FROM grid)""")
def ablation_decision(spark, sf):
    name = F.concat_ws(" ", "model", F.round(C("threshold") * 100).cast("int").cast("string"))
    return decide.ablation_decision(grid(spark, sf).select(name.alias("variant"), F.round(C("f1") - 0.4, 6).alias("delta_test"), F.round("mcc", 6).alias("delta_validation")))


@query("prep", """SELECT group12 AS value, 'C_' || category_norm AS category_norm, price, "order" FROM prep WHERE split = 'test'""")
def export_frame(spark, sf):
    from basketry.sources.sinks import export_frame as export

    df = prepared(spark, sf).where("split = 'test'").withColumn("value", C("group12"))
    return export(df, ["value", "category_norm", "price"], "order")
