import random
from decimal import Decimal

import numpy as np

from gleanery.operators.images import admit_by_budget, plan_images, rewrite_images, settled

BODY = """![a](https://e.com/1.png "t") ![b](<https://e.com/2 (x).png>) ![c](https://e.com/a_\\(b\\).png)
![d](data:image/png;base64,AA) ![rel](/x.png) ![again](https://e.com/1.png)
\\![esc](https://e.com/esc.png) `![code](https://e.com/code.png)` ``a ` ![code2](https://e.com/code2.png)``
![two
lines](https://e.com/3.png)
> ```
> ![f](https://e.com/fence.png)
> ```
~~~~
![g](https://e.com/fence2.png)
~~~
~~~~
- <table><tr><td><img alt="src=no" src="https://e.com/t.png?a=1&amp;b=2"></td></tr></table>
![nest [in]](https://e.com/n(1).png)"""

URLS = [
    "https://e.com/1.png", "https://e.com/2 (x).png", "https://e.com/a_(b).png", "https://e.com/3.png", "https://e.com/t.png?a=1&b=2", "https://e.com/n(1).png",
]


def docs(spark, body=BODY):
    return spark.createDataFrame([(7, body)], "doc_id bigint, body string")


def test_plan(spark):
    got = [(r["index"], r.url) for r in plan_images(docs(spark)).orderBy("index").collect()]
    assert got == list(enumerate(URLS, 1))
    assert plan_images(docs(spark), 2).count() == 2


def test_nesting(spark):
    deep, alt = "(" * 20 + "x" + ")" * 20, "[" * 20 + "y" + "]" * 20
    body = f"![a](https://e.com/a{deep}.png) ![{alt}](https://e.com/2.png) ![x](https://e.com/a(b(c(d))).png)\n![open](https://e.com/a(b(c) x) ![end](<https://e.com/e>x) ![far](https://e.com/{'(' * 70}q{')' * 70})"
    want = [f"https://e.com/a{deep}.png", "https://e.com/2.png", "https://e.com/a(b(c(d))).png", "https://e.com/a(b(c)", "https://e.com/e"]
    assert [r.url for r in plan_images(docs(spark, body)).orderBy("index").collect()] == want
    local = spark.createDataFrame([(7, u, i, "png") for i, u in enumerate(want, 1)], "doc_id bigint, url string, index int, ext string")
    out = rewrite_images(docs(spark, body), local).first().body
    assert out == body.replace(want[0], ".assets/7/1.png").replace(want[1], ".assets/7/2.png").replace(want[2], ".assets/7/3.png").replace(want[3], ".assets/7/4.png").replace("https://e.com/e", ".assets/7/5.png")


def test_rewrite(spark):
    rows = [(7, u, i, None if i == 4 else "png") for i, u in enumerate(URLS, 1)]
    downloads = spark.createDataFrame(rows, "doc_id bigint, url string, index int, ext string")
    out = rewrite_images(docs(spark), downloads).first().body
    want = (
        BODY.replace("(https://e.com/1.png", "(.assets/7/1.png")
        .replace("https://e.com/2 (x).png", ".assets/7/2.png")
        .replace("https://e.com/a_\\(b\\).png", ".assets/7/3.png")
        .replace("https://e.com/t.png?a=1&amp;b=2", ".assets/7/5.png")
        .replace("https://e.com/n(1).png", ".assets/7/6.png")
    )
    assert out == want


def brute(sizes, per_item, total):
    left, out = total, []
    for s in sizes:
        ok = s <= per_item and left > 0 and s <= left
        left -= s if ok else 0
        out.append(ok)
    return out


def test_blocks_match_the_rule(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for record in range(6):
        sizes = [rng.choice([0, 1, 2, 3, 5, 9, 17, 33, 60]) for _ in range(rng.choice([3, 40, 120]))]
        for pos, size in enumerate(sizes):
            rows.append((record, pos, size))
        want.update({(record, p): ok for p, ok in enumerate(brute(sizes, 40, 100))})
    items = spark.createDataFrame(rows, "record int, pos int, size int")
    for limit in (1000, 7):
        got = {(r.record, r.pos): r.admitted for r in admit_by_budget(items, 40, 100, cut=limit).collect()}
        assert got == want


def test_fractional_sizes_are_exact(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for record in range(30):
        sizes = [Decimal(rng.choice([1, 2, 3, 7, 13, 33, 101, 250])) / 10 + (record % 2) * rng.choice([0, 1, 3]) * Decimal("1e-9") for _ in range(40)]
        rows += [(record, pos, float(size)) for pos, size in enumerate(sizes)]
        taken = brute(sizes, Decimal(20), Decimal("30.3"))
        want.update({(record, p): ok for p, ok in enumerate(taken)})
    items = spark.createDataFrame(rows, "record int, pos int, size double")
    for limit in (1000, 7):
        got = {(r.record, r.pos): r.admitted for r in admit_by_budget(items, 20, 30.3, cut=limit).collect()}
        assert got == want


def test_unknown_size_is_not_admitted(spark):
    items = spark.createDataFrame([(1, pos, size) for pos, size in enumerate([3.0, None, 5.0])], "record int, pos int, size double")
    for limit in (1000, 2):
        assert {r.pos: r.admitted for r in admit_by_budget(items, 20, 30, cut=limit).collect()} == {0: True, 1: False, 2: True}


def test_budget_beyond_64_bits(spark):
    rng = random.Random(13)
    sizes = [rng.choice([1.5, 3e9, 7.25e9, 2e10, 0.0]) for _ in range(60)]
    items = spark.createDataFrame([(None if n % 2 else 1, n, s) for n, s in enumerate(sizes)], "record int, pos int, size double")
    got = {r.pos: r.admitted for r in admit_by_budget(items, 1e10, 5e10, cut=9).collect()}
    for odd in (0, 1):
        mine = list(range(odd, 60, 2))
        assert [got[n] for n in mine] == brute([Decimal(sizes[n]) for n in mine], 10**10, 5 * 10**10)


def test_settled_is_the_plain_rule():
    rng = random.Random(14)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 2, 3, 8, 9, 31, 64, 200]) for _ in range(rng.randrange(0, 40))]
        left = rng.choice([0, 1, 5, 64, 100, 1000])
        taken = brute(sizes, 10**9, left)
        got, rest = settled(np.array(sizes, np.int64), left)
        assert got.tolist() == taken and rest == left - sum(s for s, ok in zip(sizes, taken, strict=True) if ok)


def test_only_long_records_pass_block_by_block(spark, monkeypatch):
    """Positions far apart made every item of a short record a block of its own."""
    from gleanery.operators import images

    passed = []
    left_before = images._left_before
    monkeypatch.setattr(images, "_left_before", lambda blocks, *rest: passed.append(blocks) or left_before(blocks, *rest))
    rng = random.Random(14)
    sizes = {r: [rng.choice([1, 5, 17, 33, 60]) for _ in range(30 if r == 3 else 4)] for r in range(12)}
    rows = [(r, pos * 10**9, size) for r, mine in sizes.items() for pos, size in enumerate(mine)]
    got = admit_by_budget(spark.createDataFrame(rows, "record int, pos bigint, size int"), 40, 100, cut=8).collect()
    assert {(r.record, r.pos // 10**9): r.admitted for r in got} == {(r, n): ok for r, mine in sizes.items() for n, ok in enumerate(brute(mine, 40, 100))}
    assert {r.record for r in passed[0].collect()} == {3}
