"""Stored sums of the conditional encodings: as of each block, in batches, repeated batches, and later rows after a build."""

import math

from pyspark.sql import functions as F

from basketry.operators import encoding_store, history
from basketry.operators.encoding_store import EncodingStore, encoded
from basketry.plans import build, frames
from basketry.schema import FEATURE_SETS
from basketry.sources import adapter

SF = "/root/testdata/sf0.001"
NAMES = [e.name for e in history.ENCODINGS]


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


def assert_equal(left, right, columns):
    a, b = ({r["lineID"]: r for r in df.select("lineID", *columns).collect()} for df in (left, right))
    assert a.keys() == b.keys() and len(a) > 20
    for k, r in a.items():
        assert all(same(r[c], b[k][c]) for c in columns), (k, r, b[k])


def test_as_of_each_block_equals_the_forward_encodings(spark):
    train = frames.featured(spark, SF).where("split = 'train'").withColumn("availability", F.when(F.col("lineID") % 9 > 0, F.col("availability"))).persist()
    wanted = train
    for e in history.ENCODINGS:
        wanted = history.forward_encode(wanted, e)
    blocks = sorted(r[0] for r in train.select("week_block").distinct().collect())
    assert_equal(encoded(train, encoding_store.cells(train), F.col("week_block"), history.ENCODINGS, blocks), wanted, NAMES)


def test_batches_add_up_and_can_be_repeated(spark, tmp_path):
    rows = frames.featured(spark, SF).where("split is not null").persist()
    train, old = rows.where("split = 'train'"), F.col("day") < 50
    store = EncodingStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        store.add(train.where(old), rows.where(old), "a")
        store.add(train.where(~old), rows.where(~old), "b")
    key = lambda df: sorted(((str(r.asDict())) for r in df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"}).select(*sorted(df.columns)).collect()))
    assert key(store.cells()) == key(encoding_store.cells(train))
    assert key(store.counters()) == key(encoding_store.counters(rows))


def test_rows_after_a_build_get_what_a_build_over_all_gives_them(spark, tmp_path):
    fact, dim = adapter.fact(spark, SF), adapter.dim(spark, SF)
    build.run(fact.where("day < 82"), dim, f"file://{tmp_path}/out", "safe_plus_conditional")
    got = build.score_later(fact.where("day between 82 and 92"), dim, f"file://{tmp_path}/out").persist()
    wanted = frames.final(spark, SF).where("split = 'validation'").persist()
    assert_equal(got, wanted, sorted({*FEATURE_SETS["cls_final"], *FEATURE_SETS["reg_final"], "day_7_qty_mean_oof", "week_order", "num_pid_order"}))
    # A further week joins the training rows.
    build.store_of(spark, f"file://{tmp_path}/out").add(got.where("day < 86"), got.where("day < 86"), "week")
    later = build.score_later(fact.where("day between 86 and 92"), dim, f"file://{tmp_path}/out")
    both = wanted.where("false").unionByName(frames.final(spark, SF)).where("split = 'train' or day between 82 and 85").drop(*(e.name for e in encoding_store.EVERY))
    assert_equal(later, encoded(wanted.where("day >= 86").drop(*(e.name for e in encoding_store.EVERY)), encoding_store.cells(both)), ["pid_prob", "group12_order", "week_order", "day_7_qty_mean_oof"])
    assert_equal(later, wanted.where("day >= 86"), ["pid_total_events", "order_time", "pid_segment", "price_diff_bin"])
