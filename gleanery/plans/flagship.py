"""The headline job: what a crawl adds to the library, per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import urls as U
from gleanery.operators.pages import MIN_TEXT_LENGTH


def site_report(pages: DataFrame) -> DataFrame:
    """Per site: pages in the latest state of their key, split by text gate.

    One scan projects each page to a narrow row before anything is shuffled;
    the latest page per key and the per-site counts are both partial
    aggregates, so a hot site or key never meets in one task unreduced.
    """
    narrow = pages.select(
        "page_id",
        U.canonical(F.col("url")).alias("source"),
        F.length(H.html_title(F.col("html"))).alias("title_length"),
        F.length(H.visible_text(H.content_markup(F.col("html")))).alias("text_length"),
    )
    # max_by on plain numbers aggregates by hash; a max over a struct would sort
    latest = narrow.groupBy("source").agg(
        F.max_by("title_length", "page_id").alias("title_length"), F.max_by("text_length", "page_id").alias("text_length")
    )
    full = F.col("text_length") >= MIN_TEXT_LENGTH
    return (
        latest.groupBy(U.site_of(F.col("source")).alias("site"))
        .agg(
            F.count("*").alias("pages"),
            F.sum(F.when(full, 1).otherwise(0)).alias("full_pages"),
            F.sum(F.when(full, 0).otherwise(1)).alias("fallback_pages"),
            F.sum("text_length").alias("text_chars"),
            F.max("title_length").alias("longest_title"),
        )
    )
