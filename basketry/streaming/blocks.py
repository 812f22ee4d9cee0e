"""Event time per key and by window: rows are held until the watermark has passed them, then handled in the order of time.

The history of a key needs its rows in order, whatever the order in which batches bring them. So the
state holds the rows that the watermark has not passed; once it has, they are counted and emitted by
time, and the state keeps two counts and the last session of each key. Keys share a state by a hash of
BUCKETS values, so a batch has as many calls as there are buckets and not as keys, each over arrays. Rows that come after the
watermark has passed their time are emitted as late, without counts. State is bounded by what comes
within the delay, and by the idle time after which a key is forgotten.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = "event_id long, user_id long, ts timestamp, kind string, earlier_events long, earlier_orders long, session_start timestamp"
#: Buckets of users, each with one state.
BUCKETS = 256
#: For each user: counts of what was emitted, the last time and the start of its session in microseconds; and the held rows.
STATE = "users array<long>, n array<long>, orders array<long>, last array<long>, session array<long>, held_user array<long>, held_ts array<long>, held_id array<long>, held_order array<long>"


def windowed_rates(events: DataFrame, late: str = "1 day", width: str = "7 days", slide: str | None = None) -> DataFrame:
    """Events and order rate of each event-time window. In append mode a window is emitted once the watermark has passed it, its state goes, and later rows of it are dropped.

    Rows without an event_id move the watermark alone.
    """
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"))
    return g.agg(F.count("event_id").alias("n_events"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("order_rate")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "order_rate")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "1 day") -> DataFrame:
    """Events and orders of each user's sessions: runs of events less than `gap` apart, emitted once the watermark has passed their end."""
    w = F.session_window("ts", gap)
    g = events.withWatermark("ts", late).groupBy("user_id", w.alias("w"))
    return g.agg(F.count("event_id").alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_orders")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "n_orders")


def _arrays(b: pd.DataFrame) -> np.ndarray:
    """Four rows of numbers: user, time in microseconds, event, order."""
    return np.array([b["user_id"].to_numpy("int64"), b["ts"].astype("datetime64[us]").astype("int64").to_numpy(), b["event_id"].to_numpy("int64"), (b["event_type"] == "purchase").to_numpy("int64")])


def _in_order(gap: int, idle: int | None):
    """The state function of a bucket. gap, idle: microseconds."""

    def rows(found: np.ndarray, kind: str, events=None, orders=None, session=None) -> pd.DataFrame:
        time = lambda x: pd.to_datetime(pd.Series(x), unit="us")
        count = lambda x: pd.array([pd.NA] * found.shape[1] if x is None else x, dtype="Int64")
        start = pd.Series([pd.NaT] * found.shape[1], dtype="datetime64[us]") if session is None else time(session)
        return pd.DataFrame({"event_id": found[2], "user_id": found[0], "ts": time(found[1]), "kind": kind, "earlier_events": count(events), "earlier_orders": count(orders), "session_start": start})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [np.array(x, dtype="int64") for x in (state.get if state.exists else ([],) * 9)]
        known, held = np.array(kept[:5]), np.array(kept[5:])
        passed = state.getCurrentWatermarkMs() * 1000
        new = np.concatenate([np.empty((4, 0), "int64"), *(_arrays(b) for b in batches)], axis=1)
        late = new[:, new[1] < passed]
        pending = np.concatenate([held, new[:, new[1] >= passed]], axis=1)
        pending = pending[:, np.lexsort(pending[[3, 2, 1, 0]])]
        done, pending = pending[:, pending[1] < passed], pending[:, pending[1] >= passed]
        if done.shape[1]:
            user, ts, _, order = done
            every = np.union1d(known[0], user)
            was = np.zeros((5, len(every)), "int64")
            was[0] = every
            was[:, np.searchsorted(every, known[0])] = known
            _, n, orders, last, session = was[:, np.searchsorted(every, user)]
            first = np.append(True, user[1:] != user[:-1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(user)), 0))
            events = n + np.arange(len(user)) - begin
            before = np.cumsum(order) - order
            earlier = orders + before - before[begin]
            previous = np.where(first, last, np.append(0, ts[:-1]))
            fresh = (events == 0) | (ts - previous >= gap)
            marks = np.maximum.accumulate(np.where(fresh | first, np.arange(len(user)), 0))
            started = np.where(fresh, ts, session)[marks]
            yield rows(done, "in order", events, earlier, started)
            ends = np.append(first[1:], True)
            was[1:, np.searchsorted(every, user[ends])] = np.array([events + 1, earlier + order, ts, started])[:, ends]
            known = was
        if late.shape[1]:
            yield rows(late, "late")
        waiting = np.isin(known[0], pending[0])
        if idle is not None:
            stays = waiting | (known[3] + idle >= passed)
            known, waiting = known[:, stays], waiting[stays]
        if not known.shape[1] and not pending.shape[1]:
            if state.exists:
                state.remove()
            return
        state.update(tuple(x.tolist() for x in (*known, *pending)))
        # Timers are in milliseconds, and lie ahead of the watermark.
        wakes = [*pending[1].tolist(), *([] if idle is None else (known[3, ~waiting] + idle).tolist())]
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes) // 1000 + 1, passed // 1000 + 1))

    return run


def _microseconds(x: datetime.timedelta | None) -> int | None:
    return None if x is None else x // datetime.timedelta(microseconds=1)


def running_history(events: DataFrame, late: str = "1 day", gap: datetime.timedelta = datetime.timedelta(days=1), idle: datetime.timedelta | None = None) -> DataFrame:
    """For each event the number of events and orders of its user before it in (ts, event_id), and the start of its session.

    late: how long rows are waited for. kind is 'in order', or 'late' for rows behind the watermark, which have no
    counts and are counted nowhere. idle: a user whose last event lies so far behind the watermark is
    forgotten, and starts again from zero; None keeps two counts for every user. Rows without a user, an
    id or a time are left out; those without an event_id move the watermark.

    A row enters twice: as a tick, which alone carries the watermark and ends there, and as data
    without an event-time column, so that Spark does not drop it before the state function can tell
    that it is late.
    """
    none = lambda t: F.lit(None).cast(t)
    tick = F.struct(F.col("ts").alias("mark"), none("long").alias("event_id"), none("long").alias("user_id"), none("timestamp").alias("ts"), none("string").alias("event_type"))
    data = F.struct(none("timestamp").alias("mark"), F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event_type"))
    parts = F.when(F.col("event_id").isNotNull() & F.col("user_id").isNotNull(), F.array(tick, data)).otherwise(F.array(tick))
    both = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").select(F.explode(parts).alias("x")).select("x.*")
    # This condition alone: another would be moved before the watermark, and the ticks with it.
    held = both.withWatermark("mark", late).where("mark is null")
    bucketed = held.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)))
    return bucketed.groupBy("bucket").applyInPandasWithState(_in_order(_microseconds(gap), _microseconds(idle)), HISTORY, STATE, "append", GroupStateTimeout.EventTimeTimeout)
