import random
import unicodedata

from pyspark.sql import functions as F

from gleanery.functions.names import base_name, media_base_name
from gleanery.operators.names import skip_steps, unique_names


def brute(bases, existing, ext=".md"):
    taken = {e.lower() for e in existing}
    out = []
    for b in bases:
        name, n = b + ext, 2
        while name.lower() in taken:
            name, n = f"{b} ({n}){ext}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out


def run(spark, bases, existing, **options):
    clips = spark.createDataFrame([(i, i, b) for i, b in enumerate(bases)], "id bigint, seq bigint, base string")
    files = spark.createDataFrame([(e,) for e in existing], "file string")
    return [r["file"] for r in unique_names(clips, files, **{"cut": 3, **options}).orderBy("id").collect()]


def test_literal_number_collides(spark):
    bases = ["a", "A", "a (2)", "a", "a (2)", "a (3)", "b"]
    existing = ["b.md", "B (3).md", "c.txt"]
    assert run(spark, bases, existing) == brute(bases, existing)


def test_random_families(spark):
    rng = random.Random(7)
    names = ["a", "A", "a (2)", "a (3)", "a (5)", "a (2) (2)", "a (2) (3)", "a (02)", "a (1)", "b", "b (4)"]
    for seed in range(4):
        bases = [rng.choice(names) for _ in range(60)]
        existing = [n + ".md" for n in rng.sample(names, seed)]
        assert run(spark, bases, existing) == brute(bases, existing), (bases, existing)


def test_many_existing_numbers(spark):
    existing = ["a.md"] + [f"a ({n}).md" for n in range(2, 40) if n % 7]
    bases = ["a", "a (7)", "a", "a (14)", "a", "a (21)", "a", "a", "a (50)", "a"]
    assert run(spark, bases, existing) == brute(bases, existing)


def test_many_rivals_in_blocks(spark):
    rng = random.Random(3)
    bases = [rng.choice(["a", "a", f"a ({rng.randrange(2, 160)})", f"A ({rng.randrange(2, 160)})", "c", f"c ({rng.randrange(2, 20)})", "a (999999999999)"]) for _ in range(400)]
    existing = [f"a ({n}).md" for n in range(5, 100, 9)]
    for rivals in (4, 1000):
        assert run(spark, bases, existing, cut=50, rivals=rivals) == brute(bases, existing)


def test_names_are_compared_once_per_title(spark):
    bases = ["Ä", "ä", "a\u0308", "ä (3)", "Ä", "b", "ä", "B (2)", "b", "ä", "b"] + ["ä", "B"] * 20
    existing = ["Ä (2).md", "b (7).md"]
    clips = spark.createDataFrame([(i, i, b) for i, b in enumerate(bases)], "id bigint, seq bigint, base string")
    got = unique_names(clips, spark.createDataFrame([(e,) for e in existing], "file string"), cut=5)
    # records meet by number, not by comparing their names
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collate" not in plan.lower() and "UNICODE" not in plan
    want = brute([unicodedata.normalize("NFC", b) for b in bases], existing)
    assert [unicodedata.normalize("NFC", r.file) for r in got.orderBy("id").collect()] == want


def test_steps_of_a_block(spark):
    rng = random.Random(5)
    cases = [[rng.randrange(-3, 12) for _ in range(rng.randrange(0, 14))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, limits array<bigint>")
    for r in df.select("i", skip_steps(F.col("limits")).alias("steps")).collect():
        for before in range(14):
            skipped = before
            for limit in cases[r.i]:
                skipped += skipped < limit
            assert before + sum(x > before for x in r.steps) == skipped, (cases[r.i], before)


def test_base_names(spark):
    rows = [("a/b:c\td",), ("  ..hidden  x ",), ("x" * 61,), ("",), ("...",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(base_name(F.col("t"))).collect()]
    assert got == ["a-b-c-d", "hidden x", "x" * 59 + "…", "Untitled", "Untitled"]
    media = spark.createDataFrame([("Page", "pic.jpg"), ("pic", "pic.jpg"), ("", "1706.0376"), ("Page", "")], "t string, f string")
    assert [r[0] for r in media.select(media_base_name(F.col("t"), F.col("f"))).collect()] == ["Page - pic", "pic", "1706.0376", "Page"]
