"""A small table with every awkward row, and helpers."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "é", "ou", "Re", "st", "ing", "x7"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(words))


def awkward() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 300)
    near = " ".join(b.split(" ")[:-3] + ["changed", "at", "last"])
    rows = [
        (1, a), (2, a), (3, b), (4, near), (5, None), (6, ""), (7, "one two"), (8, "One\ttwo "), (9, " \n\x0b "),
        (None, a), (None, None), (None, "only this text has no identifier at all, and nothing else is like it"), (10, b), (10, b),
        (11, prose(3, 9)), (12, "a b c d e " * 40), (13, prose(4, 60) + "\n" + "same line here\n" * 5), (14, prose(5, 40_000)), (15, "<|endoftext|> it's ~~  x́ İ Σς <|startoftext|>don't"),
        (16, a + " tail"), (17, "###$$$ %% && | <> *"), (18, "x" * 30_000), (19, "0123456789" * 60), (20, prose(6, 10) + a[100:500] + prose(7, 12)),
    ]
    return [(i, t, "en", None if i in (3, 11) else f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]


#: Names that operators use inside or add.
CLASHES = ["kept", "n_tokens", "text_sha256", "k1", "k2", "h", "rep", "bucket", "label", "length", "sequence_id", "shard", "depth", "prefix", "_h", "host", "z", "at", "row", "_id", "piece"]


def table(spark, clash: bool = True):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
