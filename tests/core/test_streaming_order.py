"""Streams of several batches out of order: counts in the order of time, late rows, forgotten keys, sessions and windows."""

import datetime as dt
import uuid

import pytest

from basketry.streaming import blocks

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"


def at(day, hour=0):
    return START + dt.timedelta(days=day, hours=hour)


@pytest.fixture
def stream(spark, tmp_path):
    """From batches of rows to the rows that come out, batch by batch."""

    def run(batches, plan):
        folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        df = plan(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        q = df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/out").collect(), q

    return run


END = [(None, None, at(400), None)]


def test_three_batches_out_of_order_equal_one_sorted_table(stream):
    rows = [(k, k % 3, at((k * 7) % 11, k % 5), "purchase" if k % 4 == 0 else "click") for k in range(60)] + [(100, None, at(3), "click"), (101, 1, None, "click")]
    got, _ = stream([rows[0::3], rows[1::3], rows[2::3], END], lambda s: blocks.running_history(s, late="30 days"))
    wanted = set()
    for user in range(3):
        orders, last, session = 0, None, None
        for n, (event, _, ts, kind) in enumerate(sorted((r for r in rows if r[1] == user and r[2]), key=lambda r: (r[2], r[0]))):
            session = ts if last is None or ts - last >= dt.timedelta(days=1) else session
            wanted.add((event, user, ts, "in order", n, orders, session))
            orders, last = orders + (kind == "purchase"), ts
    assert {tuple(r) for r in got} == wanted and len(got) == 60


def test_an_earlier_click_in_a_later_batch(stream):
    batches = [[(1, 7, at(5), "purchase")], [(2, 7, at(1), "click")], END]
    got, _ = stream(batches, lambda s: blocks.running_history(s, late="10 days"))
    assert {(r["event_id"], r["kind"], r["earlier_events"], r["earlier_orders"]) for r in got} == {(1, "in order", 1, 0), (2, "in order", 0, 0)}
    got, _ = stream(batches, lambda s: blocks.running_history(s, late="1 day"))
    assert {(r["event_id"], r["kind"], r["earlier_events"], r["earlier_orders"]) for r in got} == {(1, "in order", 0, 0), (2, "late", None, None)}


def test_idle_keys_are_forgotten_and_state_stays_small(stream):
    batches = [[(k, 100 + k, at(5 * k), "purchase")] for k in range(8)] + [[(50, 100, at(40), "click")], END]
    kept, _ = stream(batches, lambda s: blocks.running_history(s, late="1 day"))
    assert {r["event_id"]: r["earlier_events"] for r in kept}[50] == 1
    got, q = stream(batches, lambda s: blocks.running_history(s, late="1 day", idle=dt.timedelta(days=6)))
    assert {r["event_id"]: r["earlier_events"] for r in got} == {**dict.fromkeys(range(8), 0), 50: 0}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 4 and sizes[-1] == 0


def test_sessions_and_windows(stream):
    rows = [(1, 1, at(0), "click"), (2, 1, at(0, 10), "purchase"), (3, 1, at(3), "click"), (4, 2, at(1), "click")]
    batches = [rows[2:], rows[:2], END]
    got, _ = stream(batches, lambda s: blocks.sessions(s, late="10 days"))
    assert {tuple(r) for r in got if r["user_id"]} == {(1, at(0), at(1, 10), 2, 1), (1, at(3), at(4), 1, 0), (2, at(1), at(2), 1, 0)}
    windows, _ = stream([rows, [(5, 1, at(30), "click")], [(7, 1, at(31), "click")], [(6, 1, at(2), "click")], END], lambda s: blocks.windowed_rates(s, late="1 day", width="7 days"))
    assert sum(r["n_events"] for r in windows) == 6  # the click of day 2 was too late for its window


def test_users_share_states(stream):
    """A state for each user made the time of a batch grow with the users."""
    rows = [(k, k % 900, at(k % 11), "purchase") for k in range(1800)]
    got, q = stream([rows[::2], rows[1::2], END], lambda s: blocks.running_history(s, late="30 days"))
    assert len(got) == 1800 and {r["earlier_events"] for r in got} == {0, 1}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 256
