"""Running values over ordered rows of a key, without one task per key.

A plain window partitioned by a key puts all rows of a hot key into one task.
Here the rows of a key are cut into *blocks*: an expression that never
decreases along the order (an hour of a timestamp, a thousand positions).  The
window runs per ``(key, block)``; one small row per block carries what earlier
blocks contribute.  Keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


#: Rows of a key from which it is cut, and blocks it is cut into at most.
DEPTH, MOST_BLOCKS = 100_000, 512


def with_depth_blocks(df: DataFrame, keys: Sequence[str], at: Column, out: str, depth: int = DEPTH, most: int = MOST_BLOCKS) -> DataFrame:
    """Add ``out``: a block number that rises with ``at`` (a bigint), about equally many rows in each block of a key.

    Keys of more than ``depth`` rows are cut at the quantiles of a sketch of
    their own ``at``, so a burst of rows is split however short it is; rows of
    equal ``at`` stay together.  The cuts are one short row per large key.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > depth)
    large = df.select(*keys, at.alias("_at")).join(sizes.select(*keys), list(keys), "left_semi")
    marks = [k / most for k in range(1, most)]
    sketch = large.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_at", marks, 16 * most)).alias("_cuts"))
    # from the evenly spaced marks of the sketch as many as the key needs
    cuts = sketch.join(sizes, list(keys)).withColumn("_step", F.greatest(F.lit(1), F.floor(F.lit(most) * depth / F.col("_rows"))))
    cuts = cuts.select(*keys, F.filter("_cuts", lambda c, i: (i + 1) % F.col("_step") == 0).alias("_cuts"))
    joined = df.withColumn("_at", at).join(cuts, list(keys), "left")
    number = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))))
    return joined.withColumn(out, number).drop("_at", "_cuts")


def _in_block(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def _over_blocks(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(BLOCK)


_BEFORE = (Window.unboundedPreceding, -1)


def sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the key."""
    rows = df.withColumn(BLOCK, block).withColumn("_v", value)
    blocks = rows.groupBy(*keys, BLOCK).agg(F.sum("_v").alias("_t"))
    carried = blocks.select(*keys, BLOCK, F.sum("_t").over(_over_blocks(keys).rowsBetween(*_BEFORE)).alias("_c"))
    joined = rows.join(carried, [*keys, BLOCK])
    local = F.sum("_v").over(_in_block(keys, order).rowsBetween(*_BEFORE))
    zero = F.lit(0)
    return joined.withColumn(out, F.coalesce(local, zero) + F.coalesce(F.col("_c"), zero)).drop(BLOCK, "_v", "_c")


def rank_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str) -> DataFrame:
    """Add ``out``: the row number within the key, from 1."""
    counted = sum_before(df, keys, order, block, F.lit(1), out)
    return counted.withColumn(out, F.col(out) + 1)


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, out: str) -> DataFrame:
    """Add ``out``: the latest non-NULL ``value`` of the earlier rows of the key."""
    rows = df.withColumn(BLOCK, block).withColumn("_v", value)
    at = F.when(F.col("_v").isNotNull(), F.struct(*order))
    blocks = rows.groupBy(*keys, BLOCK).agg(F.max_by("_v", at).alias("_t"))
    carried = blocks.select(*keys, BLOCK, F.last("_t", True).over(_over_blocks(keys).rowsBetween(*_BEFORE)).alias("_c"))
    joined = rows.join(carried, [*keys, BLOCK])
    local = F.last("_v", True).over(_in_block(keys, order).rowsBetween(*_BEFORE))
    return joined.withColumn(out, F.coalesce(local, F.col("_c"))).drop(BLOCK, "_v", "_c")


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row that follows in the key."""
    rows = df.withColumn(BLOCK, block).withColumn("_v", value)
    blocks = rows.groupBy(*keys, BLOCK).agg(F.min_by("_v", F.struct(*order)).alias("_t"))
    carried = blocks.select(*keys, BLOCK, F.lead("_t").over(_over_blocks(keys)).alias("_c"))
    joined = rows.join(carried, [*keys, BLOCK])
    local = F.lead("_v").over(_in_block(keys, order))
    return joined.withColumn(out, F.coalesce(local, F.col("_c"))).drop(BLOCK, "_v", "_c")
