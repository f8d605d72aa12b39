"""Tags of saved records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import trim_ws


def tag_counts(clips: DataFrame, prefix: str = "", limit: int | None = 8) -> DataFrame:
    """Occurrences per tag, most frequent first, ties by tag."""
    tags = clips.select(F.explode("tags").alias("tag"))
    if prefix:
        tags = tags.where(F.col("tag").startswith(prefix))
    counts = tags.groupBy("tag").agg(F.count("*").alias("count"))
    return counts if limit is None else top_tags(counts, limit)


def top_tags(counts: DataFrame, limit: int = 8) -> DataFrame:
    return counts.orderBy(F.desc("count"), F.asc("tag")).limit(limit)


def clean_tags(tags: Column) -> Column:
    """Trimmed, non-empty, first occurrence of each."""
    return F.array_distinct(F.filter(F.transform(tags, trim_ws), lambda t: t != ""))


def distinct_tags(clips: DataFrame) -> DataFrame:
    return clips.select("id", clean_tags(F.col("tags")).alias("tags"))
