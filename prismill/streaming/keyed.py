"""Keyed state with event-time timers: sessions that end when the watermark passes their pause."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of this kind lives in a store that holds more than memory does.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Keys of the state. Users are dealt into so many buckets, as a call for each user and batch costs more than its events do; a bucket of 36 million events held back would have 70,000 of them.
BUCKETS = 512

#: Columns of what waits and of what is open, packed: whether the user is null, the user, first and last time in microseconds, events.
PACKED = (("none", np.bool_), ("user", np.int64), ("start", np.int64), ("last", np.int64), ("n", np.int64))


class Sessions(StatefulProcessor):
    """The events of a bucket of users wait in a list until the watermark passes them; then they join their users' open sessions in the order of time.

    Events that wait are an element of the list for each batch, packed by columns, and the open sessions
    are a value of the same form; an event is a session of its own until then. One timer stands where the next
    thing can be decided: a pause after the first event that waits, or after an open session's
    last one. So a session goes out once, whatever the order of arrival within the watermark.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        shape = ", ".join(f"{name} binary" for name, _ in PACKED)
        self.waiting = handle.getListState("waiting", shape)
        self.open = handle.getValueState("open", shape)
        self.due = handle.getValueState("due", "at long")

    def wake(self, at: int, due: int | None) -> None:
        """Let the only timer stand at this time; ``due`` is where one stands."""
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        new = [[f["none"].to_numpy(), f["user_id"].to_numpy(), at := f["at"].to_numpy(), at, np.ones(len(f))] for f in rows if len(f)]
        if new:
            columns = [np.concatenate(c) for c in zip(*new)]
            self.waiting.appendValue(packed(columns))
            self.wake(int(columns[2].min()) // 1000 + self.gap, self.due.get()[0] if self.due.exists() else None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, gap = timerValues.getCurrentWatermarkInMs() * 1000, self.gap * 1000
        parts = [tuple(self.open.get())] if self.open.exists() else []
        parts += [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []
        none, user, start, last, n = (np.concatenate([np.frombuffer(p[i], t) for p in parts] or [np.zeros(0, t)]) for i, (_, t) in enumerate(PACKED))
        ready = last <= now  # open sessions are, as their events were
        rest = [c[~ready] for c in (none, user, start, last, n)]
        order = np.flatnonzero(ready)[np.lexsort((last[ready], user[ready], none[ready]))]
        none, user, start, last, n = (c[order] for c in (none, user, start, last, n))
        fresh = np.ones(len(user), bool)
        fresh[1:] = (none[1:] != none[:-1]) | (user[1:] != user[:-1]) | (start[1:] - last[:-1] >= gap)
        first = np.flatnonzero(fresh)
        end = np.append(first[1:], len(user))[: len(first)] - 1
        none, user, start, last, n = none[first], user[first], start[first], last[end], np.add.reduceat(n, first) if len(first) else n
        done = last + gap <= now
        going = [c[~done] for c in (none, user, start, last, n)]
        if len(rest[0]):
            self.waiting.put([packed(rest)])
        elif self.waiting.exists():
            self.waiting.clear()
        if len(going[0]):
            self.open.update(packed(going))
        elif self.open.exists():
            self.open.clear()
        ahead = [int(c.min()) // 1000 + self.gap for c in (going[3], rest[2]) if len(c)]
        if ahead:
            self.wake(max(min(ahead), now // 1000 + 1), None)
        else:
            self.due.clear()
        if done.any():
            yield pd.DataFrame({"user_id": pd.arrays.IntegerArray(user[done], none[done]), "start_at": start[done], "last_at": last[done], "n": n[done]})

    def close(self) -> None:
        pass


def packed(columns: list[np.ndarray]) -> tuple[bytes, ...]:
    return tuple(c.astype(t).tobytes() for c, (_, t) in zip(columns, PACKED))


def sessions(events: DataFrame, gap_ms: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, start, end, n) of each session, once the watermark says that it is over; wants the ``STORE`` settings."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")
    e = events.withWatermark("ts", late).select(bucket, F.col("user_id").isNull().alias("none"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("at"))
    out = e.groupBy("bucket").transformWithStateInPandas(Sessions(gap_ms), "user_id long, start_at long, last_at long, n long", "Append", "EventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("user_id", at(F.col("start_at")).alias("start"), at(F.col("last_at") + gap_ms * 1000).alias("end"), "n")
