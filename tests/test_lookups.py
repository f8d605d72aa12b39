import datetime
import random

from pyspark.sql import functions as F

from gleanery.operators.lookups import saved_lookup, take_within_ttl
from gleanery.plans.ordered import last_before, next_row, rank_in_key, sum_before, with_depth_blocks

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_block_windows_match_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), i, rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    block = F.floor(F.col("o") / 7)
    out = sum_before(df, ["k"], ["o"], block, F.lit(1), "n")
    out = rank_in_key(out, ["k"], ["o"], block, "rank")
    out = last_before(out, ["k"], ["o"], block, F.col("v"), "last")
    out = next_row(out, ["k"], ["o"], block, F.col("o"), "next")
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        got = out.where(F.col("k") == key).orderBy("o").collect()
        seen = None
        for i, (row, want) in enumerate(zip(got, mine, strict=True)):
            follow = mine[i + 1][1] if i + 1 < len(mine) else None
            assert (row.n, row["rank"], row["last"], row.next) == (i, i + 1, seen, follow)
            seen = want[2] if want[2] is not None else seen


def brute_saves(rows, index):
    known, out = dict(index), {}
    for id_, source, _, snapshot, quote, extract in sorted(rows, key=lambda r: (r[2], r[0])):
        if quote:
            out[id_] = ("saved", None)
        elif not snapshot and source in known:
            out[id_] = ("duplicate", known[source])
        else:
            known[source] = id_
            out[id_] = ("fallback" if extract == "fallback" else "saved", None)
    return out


def test_saved_lookup(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice("xxxxyz"), at(rng.randrange(400)), rng.random() < 0.1, rng.random() < 0.1, rng.choice(["full", "fallback"]))
        for i in range(150)
    ]
    index = {"y": -1}
    caps = spark.createDataFrame(rows, "id bigint, source string, ts timestamp, snapshot boolean, quote boolean, extract string")
    known = spark.createDataFrame(list(index.items()), "source string, saved_id bigint")
    for depth in (7, 1000):
        got = {r.id: (r.state, r.previous_id) for r in saved_lookup(caps, known, depth=depth).collect()}
        assert got == brute_saves(rows, index)


def test_take(spark):
    requests = spark.createDataFrame([("a", at(0), 1), ("a", at(10), 2), ("b", at(0), 3), ("c", at(0), 4)], "key string, ts timestamp, id bigint")
    opens = spark.createDataFrame([("a", at(40), 9), ("a", at(41), 8), ("b", at(31), 7)], "key string, ts timestamp, id bigint")
    got = {r.request_id: (r.status, r.open_id) for r in take_within_ttl(requests, opens, depth=1).collect()}
    assert got == {1: ("overwritten", None), 2: ("taken", 9), 3: ("expired", None), 4: ("waiting", None)}


def test_blocks_of_a_burst_are_even(spark):
    """Half the rows of one key within a second of a day: still no block much over the mean."""
    rng = random.Random(8)
    rows = [("hot", rng.randrange(10**6)) for _ in range(4000)] + [("hot", rng.randrange(86_400 * 10**6 * 30)) for _ in range(4000)] + [("small", i) for i in range(50)] + [("same", 5)] * 300
    df = spark.createDataFrame(rows, "k string, us bigint")
    got = with_depth_blocks(df, ["k"], F.col("us"), "b", depth=100, most=512)
    hot = [(r.us, r.b) for r in got.where("k = 'hot'").collect()]
    assert len(hot) == 8000 and [b for _, b in sorted(hot)] == sorted(b for _, b in hot)
    sizes = {}
    for _, b in hot:
        sizes[b] = sizes.get(b, 0) + 1
    assert len(sizes) > 60 and max(sizes.values()) < 200
    assert {r.b for r in got.where("k = 'small'").collect()} == {0} and got.where("k = 'same'").select("b").distinct().count() == 1


def test_located_clips_need_no_join(spark):
    """The join held sorts of both sides in one task beside the aggregate's own."""
    from gleanery.operators.stores import locate_clips

    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("x",)], "id string")
    first = spark.createDataFrame([("b", 1), ("c", 2), (None, 3)], "id string, n int")
    second = spark.createDataFrame([("a", 5), ("b", 6), ("a", 4)], "id string, n int")
    found = locate_clips(ids, first, second)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 4), ("b", 0, 1)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
