"""The SQL views that the oracle queries build on: the same definitions as the adapter and the cleaning, as common table expressions."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fact": ((), """
SELECT event_id AS "lineID", CAST(floor((epoch(ts) - 1704067200) / 28800) AS INTEGER) + 1 AS day, user_id AS pid,
  CASE WHEN (event_id + user_id) % 10 < 3 THEN 1 ELSE 0 END AS "adFlag",
  CASE WHEN event_id % 25 = 0 THEN 4 WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS availability,
  CASE WHEN event_id % 27 = 0 THEN NULL WHEN event_id % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(800 + user_id % 400 + event_id % 61 - 20 AS DOUBLE) / 100 END AS "competitorPrice",
  CAST(event_type = 'click' AS INTEGER) AS click, CAST(event_type IN ('view', 'signup') AS INTEGER) AS basket, CAST(event_type = 'purchase' AS INTEGER) AS "order",
  CAST(800 + user_id % 400 + event_id % 37 AS DOUBLE) / 100 AS price,
  CASE WHEN event_type = 'purchase' THEN CAST(800 + user_id % 400 + event_id % 37 AS DOUBLE) / 100 *
    CASE WHEN event_id % 10 < 7 THEN CAST(1 AS DOUBLE) WHEN event_id % 10 = 7 THEN CAST(2 AS DOUBLE) WHEN event_id % 10 = 8 THEN CAST(1 + event_id % 9 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END
    ELSE CAST(0 AS DOUBLE) END AS revenue,
  event_type
FROM events"""),
    "f": (("fact",), "SELECT * EXCLUDE (event_type) FROM fact WHERE event_type <> 'error'"),
    "dim": ((), """
SELECT p_partkey AS pid, CAST(string_split(p_brand, '#')[-1] AS BIGINT) AS manufacturer,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '7' ELSE CAST(p_size AS VARCHAR) || substr(p_type, 1, 3) END AS "group",
  CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || 'X10' WHEN 2 THEN p_size || 'x2X5' WHEN 3 THEN ' 2.5 ' WHEN 4 THEN 'PAAR' END AS content,
  CASE WHEN p_partkey % 5 = 0 THEN ' st' ELSE 'ML' END AS unit,
  CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE lower(p_type) || ' ' END AS "pharmForm",
  CAST(p_size % 10 = 0 AS INTEGER) AS "genericProduct",
  CASE p_partkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 44 WHEN 2 THEN 52 ELSE 53 END AS "salesIndex",
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(p_size % 9 AS INTEGER) END AS category,
  CASE p_partkey % 12 WHEN 0 THEN 'A' WHEN 1 THEN 'b ' WHEN 2 THEN 'C' WHEN 3 THEN '0' END AS "campaignIndex",
  CAST(1000 + p_partkey % 400 AS DOUBLE) / 100 AS rrp
FROM part"""),
    "dimx": (("dim",), """
SELECT *, CASE WHEN group_clean = 'MISSING' THEN 'MISSING' ELSE rpad(substr(group_clean, 1, 2), 2, 'X') END AS group12,
  CASE WHEN group_clean = 'MISSING' THEN 'MISSING' ELSE rpad(substr(group_clean, 3, 2), 2, 'X') END AS group34,
  CAST("campaignIndex_norm" <> 'NONE' AS INTEGER) AS has_campaign,
  CAST(coalesce(len(nums), 0) > 1 AS INTEGER) AS is_multipack,
  CASE WHEN len(nums) > 1 THEN greatest(1, CAST(floor(list_aggregate(nums[:-2], 'product')) AS INTEGER)) ELSE 1 END AS pack_n,
  nums[-1] AS pack_size,
  CASE WHEN len(nums) > 1 THEN greatest(1, CAST(floor(list_aggregate(nums[:-2], 'product')) AS INTEGER)) ELSE 1 END * nums[-1] AS pack_total_size
FROM (
  SELECT *,
    CASE WHEN upper(trim("campaignIndex")) IN ('A', 'B', 'C') THEN upper(trim("campaignIndex")) ELSE 'NONE' END AS "campaignIndex_norm",
    CASE WHEN category IS NULL THEN 'MISSING' ELSE CAST(category AS VARCHAR) END AS category_norm,
    CASE WHEN "pharmForm" IS NULL OR upper(trim("pharmForm")) IN ('', 'NAN', 'NONE') THEN 'MISSING' ELSE upper(trim("pharmForm")) END AS "pharmForm_norm",
    CASE WHEN unit IS NULL OR upper(trim(unit)) IN ('', 'NAN', 'NONE') THEN 'MISSING' ELSE upper(trim(unit)) END AS unit_norm,
    CASE WHEN "group" IS NULL OR upper(trim("group")) IN ('', 'NAN', 'NONE') THEN 'MISSING' ELSE regexp_replace(upper(trim("group")), '\\s+', ' ', 'g') END AS group_clean,
    CASE WHEN content IS NULL OR upper(trim(content)) IN ('', 'NAN', 'NONE') THEN 'MISSING' ELSE upper(trim(content)) END AS content_clean,
    list_transform(list_filter(list_transform(string_split(upper(trim(content)), 'X'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)')), lambda x: CAST(x AS DOUBLE)) AS nums
  FROM dim)"""),
    "prep": (("f", "dimx"), """
SELECT *, CASE WHEN "order" = 1 THEN CASE WHEN quantity IS NULL OR quantity < 0 OR quantity <> round_even(quantity, 0) THEN 1 ELSE 0 END ELSE 0 END AS qty_suspicious,
  CASE WHEN quantity IS NULL OR quantity < 0 THEN 'no_order' WHEN quantity <= 1 THEN '1' WHEN quantity <= 2 THEN '2' WHEN quantity <= 5 THEN '3-5' WHEN quantity <= 10 THEN '6-10' ELSE '10+' END AS quantity_class
FROM (
  SELECT f.* EXCLUDE ("competitorPrice"), CASE WHEN "competitorPrice" > 0 THEN "competitorPrice" END AS "competitorPrice",
    CAST(NOT coalesce("competitorPrice" > 0, false) AS INTEGER) AS "competitorPrice_missing",
    CASE WHEN "order" = 1 AND price > 0 THEN revenue / price END AS quantity,
    d.* EXCLUDE (pid, nums),
    CASE WHEN day BETWEEN 26 AND 70 THEN 'train' WHEN day BETWEEN 71 AND 81 THEN 'test' WHEN day BETWEEN 82 AND 92 THEN 'validation' END AS split,
    CAST(floor(CAST(day - 26 AS DOUBLE) / 7) AS INTEGER) + 1 AS week_block
  FROM f LEFT JOIN dimx d USING (pid))"""),
    "feat": (("prep",), """
SELECT *, price_discount - "competitorPrice_discount" AS price_discount_diff,
  CASE WHEN "competitorPrice" IS NOT NULL THEN CAST(price < "competitorPrice" AS DOUBLE) END AS is_lower_price,
  CASE WHEN rrp > 0 THEN CAST(price < rrp AS DOUBLE) END AS is_discount,
  CASE WHEN price_discount IS NOT NULL AND "competitorPrice_discount" IS NOT NULL THEN CAST(price_discount > "competitorPrice_discount" AS DOUBLE) END AS is_greater_discount
FROM (
  SELECT *, (day - 1) % 7 + 1 AS day_7, (day - 1) % 14 + 1 AS day_14, (day - 1) % 30 + 1 AS day_30, price - "competitorPrice" AS price_diff,
    (rrp - price) / nullif(rrp, 0) AS price_discount, (rrp - "competitorPrice") / nullif(rrp, 0) AS "competitorPrice_discount",
    price / CASE WHEN pack_total_size > 0 THEN pack_total_size END AS price_per_unit, rrp / CASE WHEN pack_total_size > 0 THEN pack_total_size END AS rrp_per_unit,
    "competitorPrice" / CASE WHEN pack_total_size > 0 THEN pack_total_size END AS "competitorPrice_per_unit"
  FROM prep)"""),
    "ranked": (("f",), """
SELECT pid, n, row_number() OVER (ORDER BY n DESC, pid) AS rnk, count(*) OVER () AS keys, sum(n) OVER () AS total FROM (SELECT pid, count(*) AS n FROM f WHERE day BETWEEN 26 AND 70 GROUP BY pid)"""),
    "seg": (("ranked",), """
SELECT pid, n AS n_events, CASE WHEN rnk <= greatest(1, ceil(keys * CAST(0.1 AS DOUBLE))) THEN 'Head' WHEN rnk <= greatest(1, ceil(keys * CAST(0.5 AS DOUBLE))) THEN 'Mid' ELSE 'Tail' END AS pid_segment FROM ranked"""),
    "scored": ((), """
SELECT l.doc_id, l.quality AS y, least(CAST(1 AS DOUBLE), CAST(d.n_chars AS DOUBLE) / 4000) AS score FROM labels l JOIN documents d USING (doc_id)"""),
    "models": (("scored",), """
SELECT 'chars' AS model, y, score FROM scored UNION ALL SELECT 'id' AS model, y, CAST(doc_id % 101 AS DOUBLE) / 100 AS score FROM scored"""),
    "grid": (("models",), """
SELECT model, threshold, tp, fp, fn, tn,
  CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS "precision",
  CASE WHEN tp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
  CASE WHEN (tp + fp) = 0 OR (tp + fn) = 0 OR (tn + fp) = 0 OR (tn + fn) = 0 THEN CAST(0 AS DOUBLE)
    ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) END AS mcc
FROM (SELECT model, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp,
    count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn
  FROM models, (SELECT CAST(k AS DOUBLE) / 100 AS threshold FROM range(5, 81) t(k)) GROUP BY model, threshold)"""),
    "stage2": (("prep",), """SELECT "lineID", pid, day, split, quantity AS y FROM prep WHERE "order" = 1 AND quantity IS NOT NULL AND qty_suspicious = 0"""),
    "predicted": (("stage2",), """
SELECT m.model, m.kind, y, CASE m.model WHEN 'always_1' THEN CAST(1 AS DOUBLE) WHEN 'mean' THEN c.mean WHEN 'median' THEN c.med ELSE CAST("lineID" % 7 AS DOUBLE) / 2 END AS prediction
FROM stage2, (SELECT avg(y) AS mean, median(y) AS med FROM stage2 WHERE split = 'train') c,
  (VALUES ('always_1', 'baseline'), ('mean', 'baseline'), ('median', 'baseline'), ('line_rule', 'model')) m(model, kind) WHERE split IN ('test', 'validation')"""),
    "regm": (("predicted",), """
SELECT model, kind, count(*) AS n, avg(power(prediction - y, 2)) AS mse, avg(abs(prediction - y)) AS mae, median(abs(prediction - y)) AS median_ae, avg(prediction - y) AS bias,
  1 - sum(power(prediction - y, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs((prediction - y) / y)) * 100 AS mape, sqrt(avg(power(prediction - y, 2))) AS rmse
FROM predicted GROUP BY model, kind"""),
    "pdc": (("feat",), """
SELECT "lineID", CASE WHEN price_diff IS NOT NULL THEN least(greatest(price_diff, lo), hi) END AS c FROM feat, (SELECT quantile_cont(price_diff, CAST(0.01 AS DOUBLE)) AS lo, quantile_cont(price_diff, CAST(0.99 AS DOUBLE)) AS hi FROM feat) b"""),
    "pde": (("pdc",), """
SELECT list_sort(list_distinct(list_transform(quantile_cont(c, [CAST(k AS DOUBLE) / 10 for k in range(0, 11)]), lambda x: round(x, 9)))) AS e FROM pdc"""),
    "pdb": (("pdc", "pde"), """
SELECT "lineID", CASE WHEN c IS NOT NULL THEN format('({:.3f}, {:.3f}]', e[k], e[least(k + 1, len(e))]) END AS price_diff_bin FROM (SELECT c.*, e.e, greatest(1, len(list_filter(e.e, lambda x: x < round(c.c, 9)))) AS k FROM pdc c, pde e)"""),
    "ppc": (("feat",), """
SELECT "lineID", CASE WHEN price_discount IS NOT NULL THEN least(greatest(price_discount, lo), hi) END AS c FROM feat, (SELECT quantile_cont(price_discount, CAST(0.01 AS DOUBLE)) AS lo, quantile_cont(price_discount, CAST(0.99 AS DOUBLE)) AS hi FROM feat) b"""),
    "ppe": (("ppc",), """
SELECT list_sort(list_distinct(list_transform(quantile_cont(c, [CAST(k AS DOUBLE) / 10 for k in range(0, 11)]), lambda x: round(x, 9)))) AS e FROM ppc"""),
    "ppb": (("ppc", "ppe"), """
SELECT "lineID", CASE WHEN c IS NOT NULL THEN format('({:.3f}, {:.3f}]', e[k], e[least(k + 1, len(e))]) END AS discount_bin FROM (SELECT c.*, e.e, greatest(1, len(list_filter(e.e, lambda x: x < round(c.c, 9)))) AS k FROM ppc c, ppe e)"""),
    "daily": (("prep", "pdb", "ppb"), """
SELECT d.*, CAST(n_click AS DOUBLE) / n_events AS click_rate, CAST(n_basket AS DOUBLE) / n_events AS basket_rate, CAST(n_order AS DOUBLE) / n_events AS order_rate,
  pid_total_events, CASE WHEN rnk <= ceil(keys * CAST(0.1 AS DOUBLE)) THEN 'Head' WHEN rnk > ceil(keys * CAST(0.5 AS DOUBLE)) THEN 'Tail' ELSE 'Mid' END AS pid_segment
FROM (SELECT day, pid, count(*) AS n_events, CAST(sum(click) AS BIGINT) AS n_click, CAST(sum(basket) AS BIGINT) AS n_basket, CAST(sum("order") AS BIGINT) AS n_order, median(price) AS price,
    first(availability ORDER BY o) FILTER (availability IS NOT NULL) AS availability, first("adFlag" ORDER BY o) AS "adFlag",
    first("campaignIndex_norm" ORDER BY o) FILTER ("campaignIndex_norm" IS NOT NULL) AS "campaignIndex_norm", first(has_campaign ORDER BY o) FILTER (has_campaign IS NOT NULL) AS has_campaign,
    first("competitorPrice_missing" ORDER BY o) AS "competitorPrice_missing",
    first(price_diff_bin ORDER BY o) FILTER (price_diff_bin IS NOT NULL) AS price_diff_bin, first(discount_bin ORDER BY o) FILTER (discount_bin IS NOT NULL) AS discount_bin,
    max(manufacturer) AS manufacturer, max(category_norm) AS category_norm, max("pharmForm_norm") AS "pharmForm_norm", max("genericProduct") AS "genericProduct", max("salesIndex") AS "salesIndex", max(is_multipack) AS is_multipack, max(pack_n) AS pack_n, max(pack_size) AS pack_size, max(rrp) AS rrp
  FROM (SELECT *, row_number() OVER (PARTITION BY day, pid ORDER BY availability NULLS LAST, "adFlag", "campaignIndex_norm" NULLS LAST, has_campaign NULLS LAST, "competitorPrice_missing", price_diff_bin NULLS LAST, discount_bin NULLS LAST) AS o FROM prep JOIN pdb USING ("lineID") JOIN ppb USING ("lineID")) GROUP BY day, pid) d
JOIN (SELECT pid, pid_total_events, row_number() OVER (ORDER BY pid_total_events DESC, pid) AS rnk, count(*) OVER () AS keys FROM (SELECT pid, count(*) AS pid_total_events FROM f GROUP BY pid)) t USING (pid)"""),
}
#: The same by split: documents with even numbers are the test rows, the others the validation rows.
VIEWS["smodels"] = (("scored",), """
SELECT model, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, y, score FROM (SELECT 'chars' AS model, * FROM scored UNION ALL SELECT 'id', doc_id, y, CAST(doc_id % 101 AS DOUBLE) / 100 FROM scored)""")
VIEWS["sgrid"] = (("smodels",), VIEWS["grid"][1].replace("model, threshold", "model, split, threshold").replace("FROM models,", "FROM smodels,"))


def with_views(sql: str, names: str, rounded: str = "", digits: int = 8) -> str:
    """sql over the named views and what they need; the columns `rounded` are rounded."""
    done: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in done:
            done.append(name)

    for n in names.split():
        add(n)
    if rounded:
        sql = "SELECT * REPLACE (" + ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in rounded.split()) + f") FROM ({sql})"
    elif sql.lstrip().startswith("WITH") and done:
        sql = f"SELECT * FROM ({sql})"
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in done) + " " if done else "") + sql
