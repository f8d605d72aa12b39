"""Captures against what is already saved, and requests against opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.plans.ordered import BLOCK, DEPTH, next_row, with_depth_blocks


def index_key(kind: Column, url: Column, media_key: Column) -> Column:
    """Store key of a capture: quotes and media have keys of their own."""
    return (
        F.when(kind == "quote", F.concat(F.lit("quote:"), U.canonical(url)))
        .when(kind == "media", media_key)
        .otherwise(U.canonical(url))
    )


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def saved_lookup(captures: DataFrame, index: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Save or duplicate, per capture, in arrival order ``(ts, id)``.

    ``captures``: ``id, source, ts, snapshot, quote, extract``; ``index``:
    ``source, saved_id``.  Snapshots and quotes always save.  A plain capture
    saves only if its key is unknown, to the index and to the batch so far;
    otherwise it is a duplicate of the latest saved record.  A key of more
    than ``depth`` captures is cut into blocks of about that many, so no key
    needs one task.
    """
    plain = with_depth_blocks(captures.where(~F.col("quote")), ["source"], _micros(), BLOCK, depth)
    at = F.struct("ts", "id")
    per_block = plain.groupBy("source", BLOCK).agg(
        F.max_by("id", F.when(F.col("snapshot"), at)).alias("snap"), F.min_by("id", at).alias("head")
    )
    over = Window.partitionBy("source").orderBy(BLOCK)
    carried = per_block.select(
        "source",
        BLOCK,
        F.last("snap", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier_snap"),
        F.first("head").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("first_id"),
    )
    local = Window.partitionBy("source", BLOCK).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    snap = F.coalesce(F.last(F.when(F.col("snapshot"), F.col("id")), True).over(local), F.col("earlier_snap"))
    in_batch = F.when(F.col("id") != F.col("first_id"), F.col("first_id"))
    known = (
        plain.join(carried, ["source", BLOCK])
        .withColumn("snap", snap)
        .join(index.select("source", "saved_id"), "source", "left")
        .withColumn("previous", F.coalesce("snap", "saved_id", in_batch))
    )
    duplicate = ~F.col("snapshot") & F.col("previous").isNotNull()
    saved = F.when(F.col("extract") == "fallback", "fallback").otherwise("saved")
    looked_up = known.select(
        "id", "source", F.when(duplicate, "duplicate").otherwise(saved).alias("state"), F.when(duplicate, F.col("previous")).alias("previous_id")
    )
    quotes = captures.where("quote").select("id", "source", F.lit("saved").alias("state"), F.lit(None).cast(captures.schema["id"].dataType).alias("previous_id"))
    return looked_up.unionByName(quotes)


def new_captures(captures: DataFrame, index: DataFrame) -> DataFrame:
    return captures.join(index.select("source"), "source", "left_anti")


def known_captures(captures: DataFrame, index: DataFrame) -> DataFrame:
    return captures.join(index.select("source"), "source", "left_semi")


#: Seconds after which a pending edit is no longer taken.
PENDING_EDIT_TTL = 30


def take_within_ttl(requests: DataFrame, opens: DataFrame, ttl: int = PENDING_EDIT_TTL, depth: int = DEPTH) -> DataFrame:
    """What becomes of each pending edit.

    The next row of the same key decides: another request overwrites it, an
    open takes it unless more than ``ttl`` seconds have passed.  So one ordered
    pass over the union of both sides does the interval join, with no pairs; keys
    of more than ``depth`` rows are cut into blocks of about that many.
    """
    both = requests.select("key", "ts", "id", F.lit(0).alias("is_open")).unionByName(
        opens.select("key", "ts", "id", F.lit(1).alias("is_open"))
    )
    blocks = with_depth_blocks(both, ["key"], _micros(), "_part", depth)
    followed = next_row(blocks, ["key"], ["ts", "is_open", "id"], F.col("_part"), F.struct("ts", "is_open", "id"), "next")
    late = F.unix_micros(F.col("next.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > ttl * 1_000_000
    status = (
        F.when(F.col("next").isNull(), "waiting")
        .when(F.col("next.is_open") == 0, "overwritten")
        .when(late, "expired")
        .otherwise("taken")
    )
    return followed.where("is_open = 0").select(
        "key", F.col("id").alias("request_id"), status.alias("status"), F.when(status == "taken", F.col("next.id")).alias("open_id")
    )
