"""Shards of bounded size by extendible hashing (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import texts, wrapped, written

#: Bytes of text that a shard may hold.
LIMIT = 4 << 20
#: Hash bits in all; rows that share every bit cannot be told apart.
MAX_BITS = 56
#: Bits that the directory grows by at a time.
STEP = 8


def hash_bits() -> Column:
    """56 bits of an MD5 over the id and, as ids may repeat, the text (columns ``doc_id``, ``text``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    return F.conv(F.substring(F.md5(key), 1, MAX_BITS // 4), 16, 10).cast("long")


def head(h: str, bits: int, of: int = MAX_BITS) -> Column:
    """The first ``bits`` of the number ``h`` of ``of`` bits."""
    return F.shiftright(F.col(h), of - bits)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Buckets of the directory: ``depth, prefix, shard_bytes, shard_docs``.

    ``sizes`` has ``_h, n_bytes`` per row.  A bucket ends when its bytes fit or
    it holds one hash value only; any other splits on the next bit.  Bytes are
    counted per prefix of STEP more bits than the level before, and the splits
    are read off these counts.  Only rows of buckets still over the limit are
    counted again for the next level, so the work shrinks to what must split.
    """
    left, base, found = sizes, 0, []
    while True:
        top = min(MAX_BITS, base + STEP)
        fine = left.groupBy(head("_h", top).alias("_p")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        # every ancestor of a counted prefix, at most STEP (at the root one more)
        levels = F.sequence(F.lit(base + 1 if base else 0), F.lit(top))
        each = fine.withColumn("depth", F.explode(levels)).withColumn("prefix", F.expr(f"shiftright(_p, {top} - depth)"))
        buckets = each.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        ends = (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))
        buckets = written(buckets.withColumn("ends", ends), f"buckets-{top}")
        split = buckets.filter("NOT ends").select((F.col("depth") + 1).alias("_d"), F.col("prefix").alias("_q"))
        first = F.col("depth") == (base + 1 if base else 0)
        born = buckets.filter("ends").join(split, (F.col("depth") == F.col("_d")) & (F.shiftright("prefix", 1) == F.col("_q")), "left")
        found.append(born.filter(first | F.col("_d").isNotNull()).select("depth", "prefix", "shard_bytes", "shard_docs"))
        over = buckets.filter((F.col("depth") == top) & ~F.col("ends")).select(F.col("prefix").alias("_over"))
        if top == MAX_BITS or over.isEmpty():
            break
        left, base = left.join(over, head("_h", top) == F.col("_over"), "left_semi"), top
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def located(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (with ``_h, n_bytes``) with ``depth, prefix, shard_bytes, shard_docs`` of their bucket."""
    buckets = written(directory(rows.select("_h", "n_bytes"), limit), "directory")
    level = (F.ceil(F.col("depth") / STEP) * STEP).cast("int")
    free = F.expr(f"cast(ceil(depth / {STEP}) * {STEP} as int) - depth")
    # a directory entry per prefix of the level's bits, at most 2^STEP for a bucket
    entries = buckets.withColumn("_free", free).select(
        "*", level.alias("_level"), F.explode(F.expr("sequence(shiftleft(prefix, _free), shiftleft(prefix + 1, _free) - 1)")).alias("_entry")
    )
    used = sorted(r[0] for r in entries.select("_level").distinct().collect())  # eight levels at most
    at = [F.struct(F.lit(n).alias("_level"), (head("_h", n) if n else F.lit(0).cast("long")).alias("_entry")) for n in used]
    keyed = rows.withColumn("_at", F.explode(F.array(*at))) if at else rows.withColumn("_at", F.struct(F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_entry")))
    keyed = keyed.select(*rows.columns, F.col("_at._level").alias("_level"), F.col("_at._entry").alias("_entry"))
    return keyed.join(entries.drop("_free"), ["_level", "_entry"]).drop("_level", "_entry")


def shard_name() -> Column:
    return F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), "0"))


def extendible_shards(docs: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """The shard of every row: ``doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, fits``.

    A shard is a bucket of an extendible hash table; ``shard`` is its prefix of
    ``depth`` hash bits (``""`` if one bucket holds all).  A text longer than the
    limit ends in a shard that holds nothing else, where ``fits`` is false; so
    do rows repeated in id and text that exceed it together, as they share
    every bit.  NULL text has no bytes; a NULL id is hashed as an empty one.
    Other columns are left out; an empty table gives no rows.
    """
    rows = written(texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), hash_bits().alias("_h")), "hashed")
    return located(rows, limit).select("doc_id", "n_bytes", shard_name().alias("shard"), "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, *, limit: int = LIMIT) -> None:
    """Write ``docs``, all columns, to Parquet folders ``shard=<prefix>`` below ``path`` (one bucket: ``shard=all``)."""
    if "shard" in docs.columns:
        raise ValueError("the table has a column shard of its own")
    rows = wrapped(docs, _h=hash_bits(), n_bytes=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    named = located(rows, limit).withColumn("shard", F.coalesce(F.nullif(shard_name(), F.lit("")), F.lit("all")))
    named.select(*(F.col("row")[c].alias(c) for c in docs.columns), "shard").repartition("shard").write.partitionBy("shard").parquet(path)
