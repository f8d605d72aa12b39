"""Projections over crawled pages: key, metadata, links, text gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import urls as U
from gleanery.functions.text import blank_to_null, trim_ws

#: Below this many characters of text a page is kept as a bookmark.
MIN_TEXT_LENGTH = 200


def canonical_sources(pages: DataFrame) -> DataFrame:
    """Dedup key and display site of each page address."""
    keyed = pages.select("page_id", U.canonical(F.col("url")).alias("source"))
    return keyed.withColumn("site", U.site_of(F.col("source")))


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, description, image, site name, published time and author."""
    staged = pages.select("page_id", "url", H.meta_entries(F.col("html")).alias("m"), H.html_title(F.col("html")).alias("t"))
    m = F.col("m")
    image = H.meta_value(m, "og:image")
    return staged.select(
        "page_id",
        F.coalesce(blank_to_null(H.meta_value(m, "og:title")), F.col("t")).alias("title"),
        F.coalesce(blank_to_null(H.meta_value(m, "og:description")), H.meta_value(m, "description")).alias("description"),
        F.when(image == "", "").otherwise(F.coalesce(U.resolve(F.col("url"), image), F.lit(""))).alias("image"),
        H.meta_value(m, "og:site_name").alias("site_name"),
        H.meta_value(m, "article:published_time").alias("published"),
        H.meta_value(m, "author").alias("author"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Every ``a[href]`` and ``img[src]`` as an absolute address, page order."""
    tag = r"""(?i)<(?:a|img)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    tags = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(H.strip_hidden(F.col("html")), F.lit(tag), 0)).alias("pos", "markup"))
    named = tags.withColumn("tag", F.when(F.col("markup").rlike(r"(?i)^<img\b"), "img").otherwise("a"))
    target = F.when(F.col("tag") == "img", H.attribute(F.col("markup"), "src")).otherwise(H.attribute(F.col("markup"), "href"))
    found = named.withColumn("target", trim_ws(target)).where(F.col("target") != "")
    resolved = found.select("page_id", "pos", "tag", U.resolve(F.col("url"), F.col("target")).alias("url"))
    return resolved.where(F.col("url").isNotNull())


def text_gate(pages: DataFrame, minimum: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Length of the visible text; short pages are only bookmarks."""
    sized = pages.select("page_id", F.length(H.visible_text(H.content_markup(F.col("html")))).alias("text_length"))
    return sized.withColumn("extract", F.when(F.col("text_length") >= minimum, "full").otherwise("fallback"))
