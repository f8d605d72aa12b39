from pyspark.sql import functions as F

from gleanery.operators.threads import thread_documents, thread_ranges


def posts(spark, rows):
    base = spark.createDataFrame(rows, "thread_id string, pos int, id string, handle string, break_before boolean, text_md string")
    return base.selectExpr(
        "*", "handle AS name", "'' AS datetime", "concat('https://x.com/', handle, '/status/', id) AS url", "false AS truncated",
        "cast(null AS array<struct<kind: string, url: string, poster: string, duration_ms: bigint, href: string>>) AS media",
        "cast(null AS struct<name: string, handle: string, datetime: string, url: string, text_md: string,"
        " media: array<struct<kind: string, url: string, poster: string, duration_ms: bigint, href: string>>, truncated: boolean>) AS quote",
        "cast(null AS struct<url: string, label: string>) AS card",
    )


def test_range_crosses_gaps_downwards_only(spark):
    rows = [("t", i, str(i), h, b, f"p{i}") for i, (h, b) in enumerate([("a", False), ("A", True), ("a", False), ("a", True), ("b", False), ("a", False)])]
    focal = spark.createDataFrame([("t", "2")], "thread_id string, focal_id string")
    got = thread_ranges(posts(spark, rows), focal).first()
    assert (got.start, got.end, got.n, got.limit) == (1, 3, 3, False)


def test_cap_comes_before_unreadable_posts(spark):
    rows = [("t", i, str(i), "a", False, None if i == 3 else f"text {i}") for i in range(60)]
    focal = spark.createDataFrame([("t", "30")], "thread_id string, focal_id string")
    doc = thread_documents(posts(spark, rows), focal).first()
    assert (doc.form, doc.posts, doc.limit, doc.partial) == ("thread", 49, True, True)
    assert doc.markdown.startswith("text 0\n\ntext 1\n\ntext 2\n\ntext 4") and doc.markdown.endswith("text 49")
    assert doc.title == "@a - text 0"
    assert thread_ranges(posts(spark, rows), focal).select(F.col("limit")).first()[0]
