"""Queries whose results SQL cannot express: models, selection and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basketry.operators import clean, grams, models, permute
from basketry.operators.encoding_store import EncodingStore, encoded, later_history
from basketry.operators.ordered import shared_dir
from basketry.plans import benchmark
from basketry.plans.frames import featured, final, prepared, safe, train_of
from basketry.plans.registry import query
from basketry.schema import feature_set
from basketry.sources import adapter
from basketry.streaming import blocks

def _sides(spark, sf, frame=final):
    """Training and validation rows."""
    df = frame(spark, sf)
    return train_of(df), df.where("split = 'validation'")


_CLS, _REG = feature_set("cls_final"), feature_set("reg_final")


@query()
def models_cls(spark, sf):
    """All 35 safe features and all rows."""
    train, validation = _sides(spark, sf, safe)
    return benchmark.run(train, validation, {"safe": feature_set("cls_expanded_safe")}, cap_train=None, cap_eval=None, regressors=()).where("task = 'cls'")


@query()
def models_reg(spark, sf):
    train, validation = _sides(spark, sf, safe)
    return benchmark.run(train, validation, {"safe": feature_set("reg_expanded_safe")}, cap_train=None, cap_eval=None, classifiers=()).where("task = 'reg'")


@query()
def embedded_selection(spark, sf):
    """Six models over all final features of their stage."""
    train, _ = _sides(spark, sf)
    out = None
    for kind in ("l1", "elastic_net", "boosted"):
        one = models.importances(models.fit_classifier(train, _CLS, kind), train, _CLS).withColumn("model", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    reg = train.where(clean.stage2())
    for kind in ("lasso", "elastic_net", "boosted"):
        out = out.unionByName(models.importances(models.fit_regressor(reg, _REG, kind), reg, _REG).withColumn("model", F.lit(f"reg_{kind}")))
    return out


@query()
def boosting_rounds(spark, sf):
    """The loss by round on the training rows that boosting is stopped by, for both stages."""
    train, _ = _sides(spark, sf)
    reg = train.where(clean.stage2())
    cls = models.boosting_curve(models.fit_classifier(train, _CLS, "boosted"), train, _CLS).withColumn("task", F.lit("cls"))
    return cls.unionByName(models.boosting_curve(models.fit_regressor(reg, _REG, "boosted"), reg, _REG, "quantity").withColumn("task", F.lit("reg")))


_STORED = ("pid_prob", "availability_likelihood", "day_7_likelihood", "group12_order", "week_order")


def _stored_sql() -> str:
    of = {"pid_prob": "pid", "availability_likelihood": "availability", "day_7_likelihood": "day_7", "group12_order": "group12", "week_order": "week_block"}
    values = ", ".join(f"""coalesce(CASE WHEN f."{of[n]}" IS NOT NULL THEN (SELECT avg(CAST(t."order" AS DOUBLE)) FROM t WHERE t."{of[n]}" = f."{of[n]}") END, (SELECT avg(CAST("order" AS DOUBLE)) FROM t)) AS {n}""" for n in _STORED)
    counts = ", ".join(f"""(SELECT CAST(coalesce(sum({v}), 0) AS BIGINT) FROM feat p WHERE p.day >= 26 AND p.pid = f.pid AND (p.day, p."lineID") < (f.day, f."lineID")) AS {n}""" for n, v in (("pid_total_events", "1"), ("order_time", 'p."order"')))
    return f"""WITH t AS (SELECT * FROM feat WHERE split = 'train') SELECT "lineID", {values}, {counts} FROM feat f WHERE split = 'validation'"""


@query("feat", _stored_sql(), " ".join(_STORED))
def later_rows(spark, sf):
    """The conditional features of the validation rows from stored sums of the earlier rows alone, added in two batches."""
    df = featured(spark, sf).where("split is not null")
    store = EncodingStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    early = F.col("day") < 54
    store.add(df.where(early & (F.col("split") == "train")), df.where(early), "early")
    store.add(df.where(~early & (F.col("split") == "train")), df.where(~early & (F.col("split") != "validation")), "late")
    rows = later_history(df.where("split = 'validation'"), store)
    return encoded(rows, store.cells()).select("lineID", *_STORED, "pid_total_events", "order_time")


@query("prep", """WITH c AS (SELECT CAST(pid AS VARCHAR) AS value, count(*) AS n, sum(CAST("order" AS DOUBLE)) AS s FROM prep WHERE split = 'train' GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place, sum(s) OVER () / sum(n) OVER () AS overall FROM c),
m AS (SELECT value, n, (s + 20 * overall) / (n + 20) AS mean FROM k WHERE place < 255)
SELECT value, n, mean, CAST(row_number() OVER (ORDER BY round(mean, 12), value) - 1 AS INTEGER) AS code FROM m""", "mean")
def ordered_codes(spark, sf):
    """The codes of a category of many values (the product) for trees."""
    return models.ordered_codes(train_of(prepared(spark, sf)), "pid", "order")


@query()
def ablation(spark, sf):
    """All nine families, left out of and added to the final features of both stages."""
    df, out = final(spark, sf), None
    for task, target, rows in (("cls", "order", df), ("reg", "quantity", df.where(clean.stage2()))):
        one = grams.family_ablation(train_of(rows), rows.where("split = 'test'"), feature_set(f"{task}_final"), target, task == "cls").withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


_GRAM = [c for c in feature_set("cls_expanded_safe") if c not in ("manufacturer_freq", "price_diff_bin", "discount_bin")]
_TEXTS = ("category_norm", "pharmForm_norm", "campaignIndex_norm", "group12", "group34")


def _gram_sql() -> str:
    """Centred columns side by side, and the mean of every product."""
    code = lambda c: f'avg("order") OVER (PARTITION BY "{c}") - avg("order") OVER ()' if c in _TEXTS else f'coalesce(CAST("{c}" AS DOUBLE) - avg("{c}") OVER (), 0)'
    columns = [*_GRAM, "order"]
    pairs = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'covariance': avg(\"{a}\" * \"{b}\")}}" for k, a in enumerate(columns) for b in columns[k:])
    inner = ", ".join(f'{code(c)} AS "{c}"' for c in columns)
    return f"SELECT u.a AS a, u.b AS b, CASE WHEN abs(u.covariance) < 0.000000001 THEN 0 ELSE u.covariance END AS covariance FROM (SELECT unnest([{pairs}]) AS u FROM (SELECT {inner} FROM feat WHERE split = 'train'))"


@query("feat", _gram_sql(), "covariance", 6)
def gram_matrix(spark, sf):
    """Mean products of all safe features and the order over the training rows."""
    # What rounding leaves of a zero has no sign.
    return grams.gram(train_of(featured(spark, sf)), _GRAM, "order").withColumn("covariance", F.when(F.abs("covariance") < 1e-9, 0.0).otherwise(F.col("covariance")))


@query()
def permutation_importance(spark, sf):
    """All features of the final set, on the validation rows, with the boosted model."""
    df, columns = final(spark, sf), feature_set("cls_final")
    model = models.fit_classifier(train_of(df), columns, "boosted")
    return permute.permutation_importance(model, df.where("split = 'validation'"), columns)


_DEALT = [c for c in feature_set("cls_expanded_safe") if c not in ("manufacturer_freq", "price_diff_bin", "discount_bin")]


def _deal_sql() -> str:
    """Each place by each feature's network, a step for each round of each walk."""
    keys = ", ".join(f"({j}, {', '.join(map(str, permute.round_keys(42_000 + j)))})" for j in range(len(_DEALT)))
    names = ", ".join(f"c{r}" for r in range(permute.ROUNDS))
    mixed = lambda x, c: f"((((({x} + {c}) % {permute.PRIME}) * (({x} + {c}) % {permute.PRIME})) % {permute.PRIME}) * {permute.FACTOR} + {c}) % {permute.PRIME}"
    steps, last = [], "w0"
    for w in range(permute.WALK):
        steps.append(f"s{w} AS (SELECT * EXCLUDE (x), x, x // b AS l, x % b AS r FROM {last})")
        inner = f"s{w}"
        for k in range(permute.ROUNDS):
            to, other, m = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
            steps.append(f"r{w}_{k} AS (SELECT * REPLACE (({to} + {mixed(other, f'c{k}')}) % {m} AS {to}) FROM {inner})")
            inner = f"r{w}_{k}"
        again = "true" if w == 0 else "x >= n"
        steps.append(f"w{w + 1} AS (SELECT * EXCLUDE (x, l, r), CASE WHEN {again} THEN l * b + r ELSE x END AS x FROM {inner})")
        last = f"w{w + 1}"
    values = ", ".join(f'max(CASE WHEN j = {j} THEN v."{c}" END) AS "{c}"' for j, c in enumerate(_DEALT))
    return f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY "lineID") - 1 AS place, count(*) OVER () AS n FROM feat WHERE split = 'validation'),
d AS (SELECT *, CAST(ceil(CAST(n AS DOUBLE) / a) AS BIGINT) AS b FROM (SELECT DISTINCT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM v)),
k(j, {names}) AS (VALUES {keys}),
w0 AS (SELECT place, CAST(place AS BIGINT) AS x, d.n, a, b, j, {names} FROM v, d, k),
{", ".join(steps)}
SELECT o."lineID", {values} FROM {last} JOIN v ON v.place = {last}.place JOIN v o ON o.place = {last}.x GROUP BY ALL"""


@query("feat", _deal_sql())
def permutation_deal(spark, sf):
    """What each validation row gets when every feature is dealt anew."""
    got = permute.dealt(featured(spark, sf).where("split = 'validation'"), _DEALT)
    return got.select("lineID", *(F.col(f"{c}__0").alias(c) for c in _DEALT))


def _replayed(spark, sf, folder: str, plan, batches: int = 4):
    """What `plan` makes of all events as a stream of several batches, out of order: an event arrives up to two days after its time.

    The last batch brings a row of a much later time, so that the watermark passes all events. A batch is as
    many files as tasks have written; the stream goes on from its checkpoint after each, so it takes them in this order.
    """
    events = adapter.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    arrival = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86400))
    timed = events.withColumn("arrival", arrival)
    ends = timed.agg(F.min("arrival"), F.max("arrival")).first()
    low, high = ends[0] or 0, ends[1] or 0
    part = F.least(F.lit(batches - 1), F.floor((F.col("arrival") - low) * batches / max(1, high - low + 1)))
    last = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c != "ts"), F.lit(high + 365 * 86400).cast("timestamp").alias("ts")).select(*events.columns)
    for rows in (*(timed.where(part == k).drop("arrival") for k in range(batches)), last):
        rows.write.mode("append").parquet(f"{folder}/in")
        df = plan(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
        q = df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("", """SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') + INTERVAL '7 days' AS window_end, count(*) AS n_events, avg(CAST(event_type = 'purchase' AS DOUBLE)) AS order_rate FROM events GROUP BY ALL""", "order_rate")
def streaming_windows(spark, sf):
    folder = f"{shared_dir(spark)}/stream-windows-{uuid.uuid4().hex}"
    return _replayed(spark, sf, folder, lambda rows: blocks.windowed_rates(rows, late="3 days"))


@query("", """SELECT event_id, user_id, count(*) OVER w AS earlier_events, CAST(coalesce(sum(CAST(event_type = 'purchase' AS BIGINT)) OVER w, 0) AS BIGINT) AS earlier_orders FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def streaming_history(spark, sf):
    folder = f"{shared_dir(spark)}/stream-history-{uuid.uuid4().hex}"
    return _replayed(spark, sf, folder, lambda rows: blocks.running_history(rows, late="3 days")).where("kind = 'in order'").select("event_id", "user_id", "earlier_events", "earlier_orders")


@query("", """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '5 days' AS session_end, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_orders FROM (
SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '5 days', true) AS fresh FROM events)) GROUP BY user_id, s""")
def streaming_sessions(spark, sf):
    folder = f"{shared_dir(spark)}/stream-sessions-{uuid.uuid4().hex}"
    return _replayed(spark, sf, folder, lambda rows: blocks.sessions(rows, late="3 days", gap="5 days")).where("n_events > 0")
