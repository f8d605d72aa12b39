from pyspark.sql import functions as F

from gleanery.operators.quotes import collect_quotes, count_entries, fragment_url, quote_notes, replace_quote_notes

DOC = "# T\n\n> one\n\n2024-01-01 10:00 · [Jump to source](https://a)\n\nnote one\nline two\n\n> two\n\n2024-01-01 10:00 (2) · [Jump to source](https://a)\n"
A1 = "2024-01-01 10:00 · [Jump to source](https://a)"
A2 = "2024-01-01 10:00 (2) · [Jump to source](https://a)"


def frame(spark, anchor, note=None):
    return spark.createDataFrame([(DOC, anchor, note)], "document string, anchor string, note string")


def test_notes(spark):
    read = [quote_notes(frame(spark, a).drop("note")).first().note for a in (A1, A2, "gone")]
    assert read == ["note one\nline two", "", None]
    assert replace_quote_notes(frame(spark, A1, " new ")).first().document == DOC.replace("note one\nline two", "new")
    assert replace_quote_notes(frame(spark, A1, "")).first().document == DOC.replace("\n\nnote one\nline two", "")
    assert replace_quote_notes(frame(spark, A2, "n")).first().document == DOC[:-1] + "\n\nn\n"
    assert replace_quote_notes(frame(spark, "gone", "n")).first().document is None
    assert frame(spark, A1).select(count_entries(F.col("document"))).first()[0] == 2


def test_fragment(spark):
    rows = [("https://a/b", "x-y", "", "", ""), ("https://a/b#top:~:text=old", "s, t", "e", "p", "q")]
    df = spark.createDataFrame(rows, "u string, s string, e string, p string, q string")
    got = [r[0] for r in df.select(fragment_url(*[F.col(c) for c in "usepq"])).collect()]
    assert got == ["https://a/b#:~:text=x%2Dy", "https://a/b#top:~:text=p-,s%2C%20t,e,-q"]


def test_parts_join_to_the_whole(spark, folder):
    from gleanery import derive

    quotes = derive.quotes(spark, folder).withColumn("source", F.lit("https://one.example/"))
    whole = collect_quotes(quotes).collect()
    cut = collect_quotes(quotes, per_part=7).orderBy("part").collect()
    assert len(whole) == 1 and len(cut) > 3
    assert "".join(r.document for r in cut) == whole[0].document
