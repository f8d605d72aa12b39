import random

import pytest

from gleanery.operators import merge
from gleanery.operators.merge import list_ranks, thread_merge
from gleanery.session import checkpoint_dir


def brute(snapshots):
    order, state = [], {}
    for cells in snapshots:
        known = set(order)
        prev, gap, seen = None, False, False
        for i, (kind, id_, handle) in enumerate(cells):
            if kind != "post":
                gap, seen = True, True
                continue
            if id_ not in order:
                after = next((c[1] for c in cells[i + 1 :] if c[0] == "post" and c[1] in known), None)
                if prev is not None:
                    order.insert(order.index(prev) + 1, id_)
                elif after is not None:
                    order.insert(order.index(after), id_)
                else:
                    order.append(id_)
                state[id_] = [handle, False]
            state[id_][0] = handle
            if seen:
                state[id_][1] = gap
            prev, gap, seen = id_, False, True
    return [(i, state[i][0], state[i][1]) for i in order]


def test_random_snapshots(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for case in range(12):
        truth = [f"p{i}" for i in range(12)]
        snapshots = []
        for _ in range(rng.randrange(2, 8)):
            start = rng.randrange(10)
            cells = []
            for p in truth[start : start + rng.randrange(1, 6)]:
                if rng.random() < 0.3:
                    cells.append(("separator", None, None))
                if rng.random() < 0.8:
                    cells.append(("post", p, rng.choice("ab")))
            snapshots.append(cells)
        want[f"l{case}"] = brute(snapshots)
        rows += [(f"l{case}", s, i, *c) for s, cells in enumerate(snapshots) for i, c in enumerate(cells)]
    cells = spark.createDataFrame(rows, "list_id string, snapshot_no int, pos int, kind string, id string, handle string")
    got = {}
    for r in thread_merge(cells).orderBy("list_id", "position").collect():
        got.setdefault(r.list_id, []).append((r.id, r.handle, r.break_before))
    assert got == {k: v for k, v in want.items() if v}


def test_rounds_of_ranking_keep_their_number_of_tasks(spark, monkeypatch):
    rows = [("l", i, i + 1 if i < 299 else None, 1) for i in range(300)]
    tokens = spark.createDataFrame(rows, "head string, token bigint, next bigint, weight bigint").repartition(4)
    seen, checkpoint = [], type(tokens).checkpoint

    def counted(self, *args, **more):
        seen.append(checkpoint(self, *args, **more))
        return seen[-1]

    checkpoint_dir(spark)
    monkeypatch.setattr(type(tokens), "checkpoint", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r.token: r.before for r in list_ranks(tokens).collect()} == {i: i for i in range(300)}
        assert len(seen) == 10 and max(df.rdd.getNumPartitions() for df in seen) <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_estimates_of_ranking_stay_short(spark, monkeypatch):
    """An estimated size that squares from round to round fills the driver: 22 rounds make it a number of some 100 MB."""
    rows = [("l", i, i + 1 if i < 99 else None, 1) for i in range(100)]
    tokens = spark.createDataFrame(rows, "head string, token bigint, next bigint, weight bigint")
    bits, checkpoint = [], type(tokens).checkpoint

    def sized(self, *args, **more):
        out = checkpoint(self, *args, **more)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    checkpoint_dir(spark)
    monkeypatch.setattr(type(tokens), "checkpoint", sized)
    assert {r.token: r.before for r in list_ranks(tokens).collect()} == {i: i for i in range(100)}
    assert len(bits) == 8 and bits[-1] - bits[0] < 40


@pytest.mark.parametrize(("linked", "near"), [(7, True), (40, False), (1000, False)])
def test_ranks_by_blocks_of_links(spark, monkeypatch, linked, near):
    """Few tokens are left to the rounds where neighbours are near each other, and all get their rank where they are not."""
    rng, rows, want, free = random.Random(3), [], {}, list(range(400))
    if not near:
        rng.shuffle(free)
    for case, size in enumerate([1, 2, 150, 17, 230]):
        ids, free = free[:size], free[size:]
        weights = [rng.randrange(4) for _ in ids]
        rows += [(f"l{case}", (i, "é"), (j, "é") if j is not None else None, w, f"also {i}") for i, j, w in zip(ids, [*ids[1:], None], weights, strict=True)]
        want |= {i: (sum(weights[:k]), f"also {i}") for k, i in enumerate(ids)}
    rng.shuffle(rows)
    pair = "struct<n: bigint, s: string>"
    tokens = spark.createDataFrame(rows, f"head string, token {pair}, next {pair}, weight int, also string").repartition(3)
    left = []
    monkeypatch.setattr(merge, "list_ranks", lambda t: left.append(t.count()) or list_ranks(t))
    checkpoint_dir(spark)
    assert {r.token.n: (r.before, r.also) for r in merge.with_ranks(tokens, linked).collect()} == want
    assert left[0] < 400 and (not near or left[0] < 100) and (linked < 400 or left[0] == 5)
