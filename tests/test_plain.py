"""Plain text of Markdown: expressions and SQL, two ways to the same text."""

import random

import duckdb
from pyspark.sql import functions as F

from gleanery.functions.markdown import plain_text
from gleanery.oracle.plain import plain

PARTS = ["word", "two words", "**bold**", "__b__", "![i](u)", "[a](b)", "[a **b** ![x](y) c](d e)", "\\*", "\\[x](y)", "\\\n", "a_b", "!x", "\n", "\n> ", "\n# ", "\n- ", "\n12. ", "\n```py\n", "\n~~~\n", " ", " ", "[l\\]x](u)", "*", "é", "\n>> q"]


def test_both_readings_agree(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 12))) for _ in range(150)] + ["", "# T", "> - x", "[a](b)[c](d)", "\\**x**"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.t for r in df.select("i", plain_text(F.col("text")).alias("t")).collect()}
    con = duckdb.connect()
    con.execute("create table d (i int, text varchar)")
    con.executemany("insert into d values (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"select i, {plain('text')} from d").fetchall())
    assert [(texts[i], got[i]) for i in got] == [(texts[i], want[i]) for i in got]
    assert got[150] == "" and got[151] == "T" and got[153] == "ac"


def test_white_space_and_escapes_by_the_plain_rules(spark):
    """Trimming, collapsing, escaping and hard breaks against the patterns they stand for."""
    import random
    import re

    from pyspark.sql import functions as F

    from gleanery.functions import inline, text

    ws = "\t\n\x0b\x0c\r         　﻿"
    rules = [
        (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"(?m)^-", r"\\-"), (r"(?m)^\+ ", r"\\+ "), (r"(?m)^(=+)", r"\\\1"), (r"(?m)^(#{1,6}) ", r"\\\1 "), ("`", r"\\`"),
        ("(?m)^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), ("(?m)^>", r"\\>"), ("_", r"\\_"), (r"(?m)^([0-9]+)\. ", r"\1\\. "),
    ]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(9))) for pool in (ws + "ab", " \nab—\u0085", " \t\\a", "-+=#~>1. *`[]_\\\n") for _ in range(300)]

    def escaped(s):
        for pattern, to in rules:
            s = re.sub(pattern, to, s)
        return s

    def stripped(s):
        return re.sub(r"(?<!\\)\\\Z", "", re.sub(r"[ \t]+\Z", "", s))

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "t", text.trim_ws(F.col("t")).alias("trim"), text.collapse(F.col("t")).alias("one"), inline.escape(F.col("t")).alias("esc"),
        inline.hard_break(F.col("t")).alias("hard"), inline.strip_hard_break(F.col("t")).alias("cut"),
    )
    for r in got.collect():
        assert r.trim == r.t.strip(ws) and r.one == re.sub(f"[{ws}]+", " ", r.t).strip(" ")
        assert r.esc == escaped(r.t) and r.cut == stripped(r.t)
        assert r.hard == bool(re.search(r"[ \t]{2,}\Z", r.t) or re.search(r"(?s)(?:^|[^\\])\\\Z", r.t))


def test_text_without_rare_spaces_is_collapsed_without_a_class_of_them(spark):
    """The class of all spaces cost most of the time of cutting units."""
    from pyspark.sql import functions as F

    from gleanery.functions.inline import plain_segment
    from gleanery.functions.text import collapse, trim_ws

    plain = str(trim_ws(F.col("t")))
    assert "REGEXP" not in plain.upper() and "contains" in str(collapse(F.col("t")))
    row = spark.createDataFrame([("So! `a` and `b`! [x *y*](u) z",), ("a!\n  b",)], "t string").select(plain_segment(F.col("t")).alias("p")).collect()
    assert [(r.p.text, r.p.codes) for r in row] == [("So! ⟦c1⟧ and ⟦c2⟧! x y z", ["`a`", "`b`"]), ("a! b", [])]
