import random

from gleanery.operators.tables import table_cells, table_kinds, table_markdown

SIMPLE = "<table><thead><tr><th>A</th><th>B|</th></tr></thead><tbody><tr><td>1</td><td>x<br>y</td></tr><tr><td>2 &amp; 3</td></tr></tbody></table>"
BANNER = "<table><tr><td colspan=2>Top</td></tr><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td colspan='2'>End</td></tr></table>"
SPANS = "<table><tr><td rowspan=0>k</td><td rowspan=2>l</td><td>m</td></tr><tr><td>n</td></tr><tr><td>o</td><td>p</td></tr></table>"
GROUPS = "<table><tbody><tr><td rowspan=5>a</td><td>b</td></tr></tbody><tbody><tr><td>c</td><td>d</td></tr></tbody></table>"
LAYOUT = "<table><tr><td><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table></td></tr><tr><td>z</td></tr></table>"
PRE = "<table><tr><td>a</td><td><pre>b</pre></td></tr><tr><td>c</td><td>d</td></tr></table>"


def frame(spark, *tables):
    return spark.createDataFrame([(1, "u", "<body><script>'<table>'</script>" + " ".join(tables) + "</body>")], "page_id bigint, url string, html string")


def grid(spark, table):
    return sorted((r.row, r.col, r.colspan, r.rowspan, r.text) for r in table_cells(frame(spark, table)).collect())


def test_spans_on_grid(spark):
    assert grid(spark, SPANS) == [(0, 0, 1, 3, "k"), (0, 1, 1, 2, "l"), (0, 2, 1, 1, "m"), (1, 2, 1, 1, "n"), (2, 1, 1, 1, "o"), (2, 2, 1, 1, "p")]
    assert grid(spark, GROUPS) == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 0, 1, 1, "c"), (1, 1, 1, 1, "d")]


def test_kinds(spark):
    cells = table_cells(frame(spark, SIMPLE, BANNER, SPANS, LAYOUT, PRE))
    got = {r.table_no: (r.kind, r.leading, r.trailing, r.header) for r in table_kinds(cells).collect()}
    assert got == {
        0: ("grid", 0, 0, True),
        1: ("grid", 1, 1, False),
        2: ("html", 0, 0, False),
        3: ("layout", 0, 0, False),
        4: ("html", 0, 0, False),
    }


def test_markdown(spark):
    cells = table_cells(frame(spark, SIMPLE, BANNER))
    got = {r.table_no: r.markdown for r in table_markdown(cells).collect()}
    assert got[0] == "| A | B\\| |\n| --- | --- |\n| 1 | x<br>y |\n| 2 & 3 |   |"
    assert got[1] == "|   |   |\n| --- | --- |\n| a | b |\n| c | d |"


def test_large_tables_are_placed_in_one_pass(spark):
    """Random spans against a plain grid, a table of many cells, and numbers beyond an int."""
    rng = random.Random(6)
    spec = [[(rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for _ in range(rng.randrange(1, 5))] for _ in range(60)]
    html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{y}.{x}</td>" for x, (w, h) in enumerate(r)) + "</tr>" for y, r in enumerate(spec)) + "</table>"
    held, want = [], []
    for y, r in enumerate(spec):
        held = sorted(h for h in held if h[2] >= y)
        at, new = 0, []
        for x, (w, h) in enumerate(r):
            for a, b, _ in held:
                at = b if a <= at < b else at
            high = min(h, len(spec) - y)
            want.append((y, at, w, high, f"{y}.{x}"))
            new += [(at, at + w, y + high - 1)] if high > 1 else []
            at += w
        held += new
    assert grid(spark, html) == sorted(want)
    big = "<table>" + ("<tr>" + "<td>x</td>" * 20 + "</tr>") * 1000 + "<tr><td colspan=99999999999 rowspan=-99999999999>y</td></tr></table>"
    got = grid(spark, big)
    assert len(got) == 20_001 and got[-1] == (1000, 0, 1000, 1, "y")
