"""Keyed stores of saved records: latest state, retention, heads, set algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many records each bounded store keeps.
LIMITS = {"pending": 20, "quote_ops": 200, "quote_entries": 50, "lost_edits": 10, "recent": 50, "finished": 20}
#: Outcomes after which a waiting item leaves the queue.
DONE_STATES = ["saved", "fallback", "duplicate"]


def latest_per_source(saves: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """Newest record per key; a patch counts only while its id is current.

    ``saves`` has ``source, saved_at, id`` and payload columns; ``patches`` has
    ``source, id, patched_at`` and the payload columns it may set.
    """
    payload = [c for c in saves.columns if c != "source"]
    ordered = ["saved_at", "id", *[c for c in payload if c not in ("saved_at", "id")]]
    newest = saves.groupBy("source").agg(F.max(F.struct(*ordered)).alias("r")).select("source", "r.*")
    if patches is None:
        return newest.select(*saves.columns)
    fields = [c for c in patches.columns if c not in ("source", "id", "patched_at")]
    last = patches.groupBy("source", "id").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("patched_at"))).alias(f"_{c}") for c in fields]
    )
    patched = newest.join(last, ["source", "id"], "left")
    return patched.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in saves.columns])


def retain_last(df: DataFrame, key: str, item: str, order: Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` items per key; entering an item again moves it to newest.

    The duplicate removal is a partial aggregate and the rank filter is pushed
    below the shuffle as a group limit, so a hot key sends at most ``n`` rows
    per task.
    """
    rest = [c for c in df.columns if c not in (key, item, *order)]
    last = df.groupBy(key, item).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, item, "r.*")
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order], F.desc(item))
    return last.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def recent_clips(index: DataFrame, n: int = LIMITS["recent"]) -> DataFrame:
    return index.orderBy(F.desc("saved_at"), "id").limit(n)


def pending_head(queue: DataFrame, n: int = 5) -> DataFrame:
    return queue.orderBy("ts", "id").limit(n)


def locate_clips(ids: DataFrame, *stores: DataFrame) -> DataFrame:
    """Each requested id from the first store that knows it.

    Stores are given in priority order and share their columns, with ``id``.
    Requests and records of an id meet in one aggregate: one shuffle, and one
    sort in a task at a time, where a join would sort both of its sides too.
    """
    columns = [c for c in stores[0].columns if c != "id"]
    union = None
    for i, s in enumerate(stores):
        tagged = s.select("id", F.struct(F.lit(i).alias("priority"), *columns).alias("hit"), F.lit(False).alias("asked"))
        union = tagged if union is None else union.unionByName(tagged)
    hit = union.schema["hit"].dataType
    union = union.unionByName(ids.select("id", F.lit(None).cast(hit).alias("hit"), F.lit(True).alias("asked")))
    found = union.where("id IS NOT NULL").groupBy("id").agg(F.min("hit").alias("hit"), F.max("asked").alias("asked"))
    return found.where("asked AND hit IS NOT NULL").select("id", "hit.*")


def pending_minus_done(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after a flush: each finished item removes one equal item."""
    done = outcomes.where(F.col("state").isin(DONE_STATES)).select(*queue.columns)
    return queue.exceptAll(done)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("state").agg(F.count("*").alias("n"))


def id_overlap(rows: DataFrame, requested: Column, found: Column) -> DataFrame:
    """Rows whose page names the id that was asked for."""
    return rows.where(F.array_contains(found, requested))
