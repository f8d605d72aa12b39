"""Exact dedup by sorting content (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import texts, unwrapped, wrapped, written

#: Leading characters that the sampled splitters of the range partitioning see.
SPLITTER_CHARS = 48
#: Runs into which the copies of one text are dealt at most.
RUNS = 1024


def content_sort(docs: DataFrame, *, splitter_chars: int = SPLITTER_CHARS, runs: int = RUNS, partitions: int | None = None) -> DataFrame:
    """One row per input row: which row of its equal texts stays.

    Sampled splitters range-partition the rows on the first characters of the
    text, then a hash of the whole text, then a run number taken from the id;
    an external sort puts equal texts side by side, by rising id, and a run
    ends where the whole text of the neighbour behind differs: its last row
    has the run's largest id, and its place is the run's size.  The run number
    deals the copies of one text over many tasks; the last rows of different
    runs meet as short rows, named by the SHA-256 of the text.  Splitters see
    no more of a text than its first characters and its hash; what they put
    together is compared whole.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.  NULL text is
    the empty text.  A NULL ``doc_id`` is smaller than any other.  Of repeated
    rows (same id, same text) one stays.  Of equal texts the largest id stays.
    An empty table gives no rows; other columns are left out.
    """
    rows = texts(docs).select(
        "doc_id", "text", F.substring("text", 1, splitter_chars).alias("_lead"), F.xxhash64("text").alias("_h"), F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("_run")
    )
    keys = ["_lead", "_h", "_run"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    # The window's keys contain those of the range partitioning, so it adds a sort within partitions and no exchange.
    beside = Window.partitionBy(*keys, "text").orderBy(F.col("doc_id").asc_nulls_first())
    # rows of one run lie side by side: the last has no equal text behind it, and its place and id are the run's size and largest id
    ends = F.lead(F.lit(True)).over(beside).isNull()
    narrow = ranged.select("doc_id", "_run", F.row_number().over(beside).cast("long").alias("_n"), ends.alias("_head"), F.sha2("text", 256).alias("text_sha256"))
    narrow = written(narrow.select("doc_id", "text_sha256", "_run", "_n", "_head"), "sorted-runs")
    # one row per run combines; a group's verdict goes to its runs, and from a run to its rows, so that rows of one text are never joined in one task
    counted = narrow.filter("_head").select("text_sha256", "_run", F.col("doc_id").alias("_max"), "_n")
    whole = counted.groupBy("text_sha256").agg(F.max("_max").alias("keep_id"), F.sum("_n").alias("group_size"))
    groups = counted.select("text_sha256", "_run").join(whole, "text_sha256")
    kept = F.col("_head") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return narrow.join(groups, ["text_sha256", "_run"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that :func:`content_sort` drops, all columns kept.

    Repeated rows with one id and one text stay once.
    """
    kept = content_sort(docs, **options).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    rows = wrapped(docs, id=docs["doc_id"], sha=F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["id"]) & (rows["sha"] == kept["sha"]), "left_semi")
    once = Window.partitionBy("id", "sha").orderBy("id")
    return unwrapped(rows.withColumn("n", F.row_number().over(once)).filter("n = 1"), docs)
