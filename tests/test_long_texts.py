"""Texts of hundreds of thousands of characters: no pattern may recurse on them."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import inline as I
from gleanery.functions import markdown as M
from gleanery.functions.text import collapse, decode_entities, yaml_string
from gleanery.operators.chunks import pieces_of
from gleanery.operators.pages import page_links
from gleanery.operators.tables import table_cells
from gleanery.operators.videos import assigned_object

N = 300_000
LONG = {
    "open bracket": "[" + "a b " * (N // 4),
    "image": "![" + "x" * N + "](http://e.com/" + "y" * N + ".png)",
    "code": "`" + "c" * N + "` *e* " + "&amp;" * 1000,
    "fence": "```\n" + "line\n" * (N // 5) + "```\n",
    "link": "[a](http://e.com/" + "(b)" * (N // 3) + ")",
    "quotes": "> " * 1000 + '"' * N,
    "lines": "words here.\n" * (N // 12),
}


@pytest.mark.parametrize("name", LONG)
def test_text_functions(spark, name):
    df = spark.createDataFrame([(LONG[name],)], "t string")
    t = F.col("t")
    row = df.select(
        F.length(M.plain_text(t)).alias("plain"), F.size(M.image_urls(M.image_pieces(t))).alias("images"), F.length(I.plain_segment(t)["text"]).alias("segment"),
        I.is_balanced(t).alias("balanced"), I.is_link_only(t).alias("link"), F.length(F.array_join(pieces_of(t), "")).alias("pieces"),
        F.length(collapse(decode_entities(t))).alias("flat"), F.length(yaml_string(t)).alias("yaml"), F.length(H.visible_text(t)).alias("text"),
    ).first()
    assert row.pieces == len(LONG[name])
    assert row.images == (1 if name == "image" else 0)


def test_page_functions(spark):
    big = "d" * N
    html = (
        f'<a href="/x" data-x="{big}">l</a><img alt="{big}" src="data:image/png;base64,{big}">'
        f'<table><tr><td title="{big}">{big}</td><td>b</td></tr><tr><td>c</td></tr></table>'
        f'<script>var v = {{"a": "{big}", "b": {{"c": [1, 2]}}}};</script>'
    )
    pages = spark.createDataFrame([(1, "https://e.com/", html)], "page_id bigint, url string, html string")
    assert [r.tag for r in page_links(pages).orderBy("pos").collect()] == ["a", "img"]
    assert table_cells(pages).count() == 3
    assert pages.select(F.length(assigned_object(F.col("html"), "v"))).first()[0] > N


def test_object_at_any_depth(spark):
    deep = '{"a": "}", "b": ' + '{"x": [' * 60 + '{"q": "\\"{"}' + "]}" * 60 + "}"
    html = f"<script>var w = {{broken; var v = {deep}; more = {{}}</script>"
    df = spark.createDataFrame([(html,), ("v = {never closed",), ("nothing",), (None,)], "html string")
    assert [r[0] for r in df.select(assigned_object(F.col("html"), "v")).collect()] == [deep, None, None, None]
