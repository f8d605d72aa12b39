"""Keyed state the built-in streaming operators cannot hold.

What counts is the order of events, not of arrival: rows of a key wait, by
bucket of event time, until the watermark has passed their bucket and are then
taken in order, so the number of files in a trigger decides nothing.  State is one row per key, handed
over with the rows of a trigger, so a key costs one call and no round trips.
The caller's delay bounds how long rows wait; it must cover how far the input
is out of order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators.stores import LIMITS
from gleanery.session import ship_package

#: At most one update per key in this time.
THROTTLE_MS = 400
#: Seconds in which an open takes the latest request.
TTL_SECONDS = 30
#: Event time of the rows that wait together.
BUCKET_MS = 60_000


class InEventOrder:
    """Hands the rows of a key to :meth:`take` in the order of :meth:`place`.

    Rows wait in the state of their key.  When the watermark passes the end of
    a bucket of event time, the bucket is complete and every later row is of a
    later one; all complete buckets of a key are taken in one call.  What the
    job itself wants to do at a time without a row (:meth:`due`) waits for the
    end of the bucket of that time.  A call holds what waits of one key.
    """

    #: Columns of a row after ``id`` and its time in microseconds.
    more: dict[str, str] = {}
    #: Columns of the result after ``key``.
    made: list[str] = []
    #: What is kept of a key between calls, and its first value.
    kept: str
    first: tuple

    def __init__(self, bucket_ms: int) -> None:
        self.bucket_ms = bucket_ms

    def place(self, row: tuple) -> tuple:
        """What rows are ordered by."""
        return row[1], row[0]

    def take(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """What is kept after the next rows in order, and their results."""
        raise NotImplementedError

    def settle(self, kept: tuple, until: int) -> tuple[tuple, list[tuple]]:
        """The same once all rows before ``until`` (in ms) are taken."""
        return kept, []

    def due(self, kept: tuple) -> int | None:
        """When the job wants to be called without a row, in ms."""
        return None

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        columns = {"key": np.full(len(out), key[0], "int64")}
        for name, values in zip(self.made, zip(*out, strict=True), strict=True):
            numbers = np.array(values, "int64")
            columns[name] = numbers.astype("datetime64[us]") if name == "ts" or name.endswith("_at") else numbers
        return pd.DataFrame(columns)

    def state_schema(self) -> str:
        held = {"ids": "bigint", "times": "bigint"} | {f"held_{name}": kind for name, kind in self.more.items()}
        return ", ".join([*(f"{name} array<{kind}>" for name, kind in held.items()), self.kept])

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = 2 + len(self.more)
        before = tuple(state.get) if state.exists else (*([] for _ in range(columns)), *self.first)
        rows, kept = list(zip(*before[:columns], strict=True)), before[columns:]
        if not state.hasTimedOut:
            for frame in frames:
                us = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
                rows += zip(frame["id"].tolist(), us, *(frame[c].tolist() for c in self.more), strict=True)
        size = self.bucket_ms
        known = state.getCurrentWatermarkMs() // size * size
        waiting = [r for r in rows if r[1] >= known * 1000]
        kept, out = self.take(kept, sorted((r for r in rows if r[1] < known * 1000), key=self.place))
        kept, more = self.settle(kept, known)
        held = map(list, zip(*waiting, strict=True)) if waiting else ([] for _ in range(columns))
        state.update((*held, *kept))
        # the next call without a row: when the first bucket that waits, or that of the job's own time, is complete
        times = [min(r[1] for r in waiting) // 1000] if waiting else []
        due = self.due(kept)
        if times or due is not None:
            state.setTimeoutTimestamp((min([*times, *([] if due is None else [due])]) // size + 1) * size)
        if out or more:
            yield self._frame(key, out + more)


class GenerationGuard(InEventOrder):
    """Drops updates of an older run than the newest before them."""

    more = {"generation": "bigint"}
    made = ["id", "ts", "generation"]
    kept = "generation bigint"
    first = (None,)

    def take(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        newest, out = kept[0], []
        for item, us, generation in rows:
            if newest is None or generation >= newest:
                newest = generation
                out.append((item, us, generation))
        return (newest,), out


class PendingQueue(InEventOrder):
    """Items wait per key, newest ``limit``, until a grant drains them in order.

    While granted, items pass at once; a revoke makes them wait again.
    """

    more = {"kind": "string"}
    made = ["id", "queued_at", "saved_at"]
    kept = "granted boolean, ids array<bigint>, us array<bigint>"
    first = (False, [], [])

    def __init__(self, limit: int, bucket_ms: int) -> None:
        super().__init__(bucket_ms)
        self.limit = limit

    def take(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        granted, queue = kept[0], deque(zip(kept[1], kept[2], strict=True), maxlen=self.limit)
        out = []
        for item, us, kind in rows:
            if kind == "revoke":
                granted = False
            elif kind == "grant":
                granted = True
                out += [(i, t, us) for i, t in queue]
                queue.clear()
            elif granted:
                out.append((item, us, us))
            else:
                queue.append((item, us))
        return (granted, [int(i) for i, _ in queue], [int(t) for _, t in queue]), out


class Throttle(InEventOrder):
    """At most one update per key and interval.

    A change of phase goes out at once; otherwise the latest value waits for
    the end of the interval, so the last one is never lost.
    """

    more = {"phase": "string"}
    made = ["id", "sent_at_ms"]
    kept = "sent bigint, phase string, id bigint, due bigint"
    first = (None, None, None, None)

    def __init__(self, interval_ms: int, bucket_ms: int) -> None:
        super().__init__(bucket_ms)
        self.interval = interval_ms

    def due(self, kept: tuple) -> int | None:
        return kept[3]

    def take(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        last, phase, *waiting = kept
        out = []
        for item, us, now_phase in rows:
            now = us // 1000
            if waiting[1] is not None and waiting[1] <= now:
                out.append(tuple(waiting))
                last, waiting = waiting[1], [None, None]
            if now_phase != phase or now_phase == "finished" or now - last >= self.interval:
                out.append((item, now))
                last, phase, waiting = now, now_phase, [None, None]
            else:
                waiting = [item, last + self.interval]
        return (last, phase, *waiting), out

    def settle(self, kept: tuple, until: int) -> tuple[tuple, list[tuple]]:
        """The value that waits, if its time has come and no row before that can change it."""
        _, phase, item, due = kept
        if due is None or due >= until:
            return kept, []
        return (due, phase, None, None), [(item, due)]


class Take(InEventOrder):
    """The latest request per key waits, and the first open within ``ttl_ms`` takes it.

    An open ends the requests before it, taken or not, as a later open cannot
    be the first after them.  Requests come before opens of the same time.
    """

    more = {"opens": "boolean"}
    made = ["request_id", "open_id", "asked_at", "opened_at"]
    kept = "id bigint, us bigint"
    first = (None, None)

    def __init__(self, ttl_ms: int, bucket_ms: int) -> None:
        super().__init__(bucket_ms)
        self.ttl = 1000 * ttl_ms

    def place(self, row: tuple) -> tuple:
        return row[1], row[2], row[0]

    def take(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        latest, out = kept, []
        for item, us, opens in rows:
            if not opens:
                latest = (item, us)
            elif latest[0] is not None:
                if us - latest[1] <= self.ttl:
                    out.append((latest[0], item, latest[1], us))
                latest = (None, None)
        return latest, out


def _run(rows: DataFrame, job: InEventOrder, schema: str, delay: str) -> DataFrame:
    ship_package()

    def call(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return job(key, frames, state)

    keyed = rows.withWatermark("ts", delay).groupBy("key")
    return keyed.applyInPandasWithState(call, schema, job.state_schema(), "append", GroupStateTimeout.EventTimeTimeout)


def stream_generation_guard(updates: DataFrame, delay: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``updates``: ``key, id, ts, generation``."""
    return _run(updates, GenerationGuard(bucket_ms), "key bigint, id bigint, ts timestamp, generation bigint", delay)


def stream_pending_queue(events: DataFrame, delay: str, limit: int = LIMITS["pending"], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``events``: ``key, id, ts, kind`` with kind push, grant or revoke."""
    return _run(events, PendingQueue(limit, bucket_ms), "key bigint, id bigint, queued_at timestamp, saved_at timestamp", delay)


def stream_throttle(updates: DataFrame, delay: str, interval_ms: int = THROTTLE_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``updates``: ``key, id, ts, phase``; a value that waits goes out when the watermark passes its time."""
    return _run(updates, Throttle(interval_ms, bucket_ms), "key bigint, id bigint, sent_at_ms bigint", delay)


def stream_take(moves: DataFrame, delay: str, ttl: int = TTL_SECONDS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Requests with the open that takes them.

    ``moves``: ``key, id, ts, opens``, an open or else a request.  State and
    result hold one row per request at most.
    """
    return _run(moves, Take(1000 * ttl, bucket_ms), "key bigint, request_id bigint, open_id bigint, asked_at timestamp, opened_at timestamp", delay)
