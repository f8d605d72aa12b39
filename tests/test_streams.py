import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery import catalog
from gleanery.session import names_in
from gleanery.streaming import jobs
from gleanery.streaming.jobs import stream_once, stream_threads, thread_sessions
from gleanery.streaming.run import drain, drain_to_end, event_stream
from gleanery.streaming.stateful import Throttle, stream_take, stream_throttle

HOURS = 3600 * 1000
DELAY = "60 days"
END = (-1, -1, datetime.datetime(2100, 1, 1))


@pytest.fixture(scope="module")
def shuffled(spark, folder, tmp_path_factory):
    """The events in six files that are not ordered by time."""
    path = str(tmp_path_factory.mktemp("events") / "files")
    spark.read.parquet(f"{folder}/events.parquet").repartition(6, "event_id").write.parquet(path)
    return path


def keyed(spark, path, per_trigger, *more):
    return event_stream(spark, path, per_trigger, "*.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", *more)


def brute(rows, interval):
    out, by_key = set(), {}
    for key, id_, ms, phase in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by_key.setdefault(key, []).append((id_, ms, phase))
    for key, events in by_key.items():
        last = phase_before = waiting = None
        for id_, now, phase in events:
            if waiting and waiting[1] <= now:
                out.add((key, *waiting))
                last, waiting = waiting[1], None
            if phase != phase_before or phase == "finished" or now - last >= interval:
                out.add((key, id_, now))
                last, phase_before, waiting = now, phase, None
            else:
                waiting = (id_, last + interval)
        if waiting:
            out.add((key, *waiting))
    return out


@pytest.mark.parametrize("per_trigger", [1, 4, 64])
def test_throttle(spark, folder, shuffled, per_trigger):
    phase = F.when(F.col("event_type") == "purchase", "finished").otherwise("running")
    stream = keyed(spark, shuffled, per_trigger, phase.alias("phase"))
    got = drain_to_end(stream, lambda s: stream_throttle(s, DELAY, 24 * HOURS), "throttle", (*END, ""))
    batch = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id", "ts", phase.alias("phase")).collect()
    epoch = datetime.datetime(1970, 1, 1)
    rows = [(r[0], r[1], (r[2] - epoch) // datetime.timedelta(milliseconds=1), r[3]) for r in batch]
    assert {(r.key, r.id, r.sent_at_ms) for r in got.collect()} == brute(rows, 24 * HOURS)


@pytest.mark.parametrize("per_trigger", [1, 4])
def test_threads_lose_nothing(spark, folder, shuffled, per_trigger):
    got = drain_to_end(keyed(spark, shuffled, per_trigger), lambda s: stream_threads(s.select("key", "ts"), "6 hours", DELAY, max_posts=3), "threads", END)
    want = thread_sessions(spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").alias("key"), "ts"), "6 hours", max_posts=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_arrival_is_several_files(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    monkeypatch.setattr(catalog, "FILE_ROWS", 500)
    catalog._arrivals.cache_clear()
    try:
        path, files, _ = catalog._arrivals(spark.sparkContext.applicationId, d)
        assert files == 3 and len(names_in(path)) == 8 * files + 1  # _SUCCESS
        got = catalog.QUERIES["st3_stream_threads"](spark, d)
    finally:
        catalog._arrivals.cache_clear()
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    want = thread_sessions(events, "6 hours", max_posts=3, max_time=36000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_once_keeps_late_rows(spark, folder, shuffled):
    twice = keyed(spark, shuffled, 1).select(F.explode(F.array("id", "id")).alias("op_id"), "ts")
    got = [r.op_id for r in drain(stream_once(twice, DELAY), "once").collect()]
    assert sorted(got) == sorted(r.event_id for r in spark.read.parquet(f"{folder}/events.parquet").collect())


def test_index_is_compacted_and_survives_a_crash(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "source string, saved_at bigint, id bigint").schema
    index = jobs.VersionedIndex(spark, str(tmp_path), schema, every=3)
    assert index.read().count() == 0
    rng, want = random.Random(1), {}

    def batch(n):
        return [(f"k{rng.randrange(9)}", 10 * n + i, i) for i in range(6)]

    def now():
        return {r.source: (r.saved_at, r.id) for r in index.read().collect()}

    for n in range(14):
        rows = batch(n)
        df = spark.createDataFrame(rows, schema)
        want |= {k: (t, i) for k, t, i in rows}
        if n == 8:  # the base is there, its mark is not
            with monkeypatch.context() as m:
                m.setattr(jobs, "mark", lambda path: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    index.add(df, n)
            assert now() == want and index._marks()[-1] == 5
        index.add(df, n)
        if n % 5 == 0:
            index.add(df, n)  # run again
        assert now() == want
        assert len(index._numbers("versions")) <= 6 and len(index._numbers("bases")) <= 2
    assert index._marks() == [8, 11]


@pytest.mark.parametrize("per_trigger", [1, 64])
def test_take_of_the_latest_request(spark, tmp_path, per_trigger):
    rng = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), i, t0 + datetime.timedelta(seconds=rng.randrange(0, 900)), rng.random() < 0.5) for i in range(300)]
    arrive = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=r[1] % 60))
    for n in range(6):
        spark.createDataFrame(arrive[50 * n : 50 * n + 50], "key bigint, id bigint, ts timestamp_ntz, opens boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key bigint, id bigint, ts timestamp, opens boolean").option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))
    got = drain_to_end(stream, lambda s: stream_take(s, "61 seconds", ttl=20, bucket_ms=30_000), "take", (-1, -1, datetime.datetime(2030, 1, 1), False))
    want, latest = set(), {}
    for key, item, at, opens in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if not opens:
            latest[key] = (item, at)
        elif key in latest:
            request, asked = latest.pop(key)
            if at - asked <= datetime.timedelta(seconds=20):
                want.add((key, request, item))
    assert {(r.key, r.request_id, r.open_id) for r in got.collect()} == want and len(want) > 20


class OneKey:
    """State of one key as the engine hands it over."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.now, self.wake = False, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        assert at > self.now
        self.wake = at


def test_many_buckets_are_one_call():
    job, state, calls = Throttle(1000, 500), OneKey(), []
    take = job.take
    job.take = lambda kept, rows: (calls.append(len(rows)), take(kept, rows))[1]
    us = [random.Random(3).randrange(0, 60_000_000) for _ in range(200)]
    frame = pd.DataFrame({"id": range(200), "ts": pd.to_datetime(us, unit="us"), "phase": "running"})
    got = [f for some in (frame[:90], frame[90:]) for f in job((7,), iter([some]), state)]
    assert state.wake == min(us) // 500_000 * 500 + 500 and calls == [0, 0]
    state.now, state.hasTimedOut = 70_000, True
    got += list(job((7,), iter([]), state))
    assert calls == [0, 0, 200] and state.get[0] == []
    rows = [(7, i, t // 1000, "running") for i, t in enumerate(us)]
    assert {tuple(r) for f in got for r in f.itertuples(index=False)} == brute(rows, 1000)
