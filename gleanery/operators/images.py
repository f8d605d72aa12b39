"""Images of stored documents: plan, download budget, rewrite."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import markdown as M
from gleanery.session import ship_package

# Attachments per record, and bytes per item and per record.
MAX_IMAGES = 100
ITEM_MAX_BYTES = 20 * 1024 * 1024
TOTAL_MAX_BYTES = 200 * 1024 * 1024
#: Sizes are added and compared as whole numbers of steps, so that no sum is rounded.
STEPS, EXACT = 10**9, "decimal(24,0)"
#: Positions of a record that are one row.
BLOCK = 4096


def plan_images(docs: DataFrame, maximum: int = MAX_IMAGES) -> DataFrame:
    """Numbered http(s) images per document, first occurrence of each address.

    A document is one row, so everything happens inside the row: no shuffle.
    """
    urls = F.filter(M.image_urls(M.image_pieces(F.col("body"))), lambda u: u.rlike(r"(?i)^https?://"))
    planned = docs.select("doc_id", F.posexplode(F.slice(F.array_distinct(urls), 1, maximum)).alias("pos", "url"))
    return planned.select("doc_id", "url", (F.col("pos") + 1).alias("index"))


def rewrite_images(docs: DataFrame, downloads: DataFrame) -> DataFrame:
    """Point downloaded images to ``.assets/<id>/<n>.<ext>``; the rest stay.

    ``downloads``: ``doc_id, url, index, ext`` of the plan, so at most
    ``MAX_IMAGES`` rows meet per document.
    """
    path = F.concat(F.lit(".assets/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("index").cast("string"), F.lit("."), F.col("ext"))
    local = downloads.where(F.col("ext").isNotNull()).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("url", path.alias("path")))).alias("local")
    )
    joined = docs.join(local, "doc_id", "left")
    rewritten = M.rewrite_targets(M.image_pieces(F.col("body")), F.col("local"))
    return joined.select("doc_id", F.when(F.col("local").isNull(), F.col("body")).otherwise(rewritten).alias("body"))


def settled(amounts: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Which of some items in order fit what is left, and what is left then.

    By halving: while at least ``unit`` is left, every item below it fits, so
    one running sum finds where that ends, and at most one item of ``unit`` to
    twice ``unit`` can fit in between.  Each turn at least halves what is left.
    """
    out = np.zeros(len(amounts), bool)
    start = 0
    while left > 0 and start < len(amounts):
        rest = amounts[start:]
        unit = (left + 1) // 2
        small = rest < unit
        room = left - np.concatenate([[0], np.cumsum(np.where(small, rest, 0))[:-1]])
        ends = np.flatnonzero(np.where(small, room - rest < unit, rest <= room) & (room >= unit))
        stop = int(ends[0]) if len(ends) else len(rest) - 1
        out[start : start + stop + 1] = small[: stop + 1]
        if len(ends):
            out[start + stop] = True
        left -= int(rest[: stop + 1][out[start : start + stop + 1]].sum())
        start += stop + 1
    return out, left


def _left_before(blocks: DataFrame, total: int, kind: str) -> DataFrame:
    """``record, _block, left``: the budget left before each block (``record, _block, amounts``).

    The blocks of a record pass in order, one row at a time.
    """
    ship_package()
    decimal = kind != "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, left = (), None
        for batch in batches:
            out = []
            for record, amounts in zip(batch.column("record").to_pylist(), batch.column("amounts").to_pylist(), strict=True):
                if here != (record,):
                    here, left = (record,), Decimal(total) if decimal else total
                out.append(left)
                left = settled(np.array(amounts, object if decimal else np.int64), left)[1]
            made = pa.array(out, pa.decimal128(24, 0) if decimal else pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("record"), batch.column("_block"), made], ["record", "_block", "left"])

    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    ordered = blocks.select("record", "_block", "amounts").repartition("record").sortWithinPartitions("record", "_block")
    return ordered.mapInArrow(run, f"record {types['record']}, _block {types['_block']}, left {kind}")


def admit_by_budget(items: DataFrame, per_item: float = ITEM_MAX_BYTES, total: float = TOTAL_MAX_BYTES, cut: int = BLOCK, block: Column | None = None) -> DataFrame:
    """Admit items ``(record, pos, size)`` in order while they fit the budget.

    A rejected item uses nothing, so this is no running sum.  A record of at
    most ``cut`` items is one row and has the whole budget.  The items of a
    longer one are cut into blocks of the order (``block``, by default ``cut``
    positions): each is one row.  What is left before each block comes from
    passing the blocks of a record in order, one at a time and by halving
    (:func:`settled`), at eight bytes an item; every block then decides its
    items by itself.  Sizes are whole billionths, so fractions
    are exact; an item of no known size is not admitted.  A NULL record is one.
    """
    total = round(Decimal(str(total)) * STEPS)
    kind = "bigint" if total < 1 << 62 else EXACT
    over = F.lit(Decimal(total + 1)).cast(kind)
    amount = F.when(F.col("size") <= per_item, (F.col("size").try_cast("decimal(24,9)") * STEPS).cast(EXACT))
    fits_at_all = F.when(amount <= Decimal(total), amount.cast(kind))
    item = F.struct("pos", F.coalesce(fits_at_all, over).alias("amount"), F.col("size").cast("double").alias("size"))
    # one key for more than ``cut`` items: a broadcast, so that the items are shuffled once, into their lists
    long = items.groupBy(F.col("record").alias("_r")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cut).select("_r")
    dealt = items.join(F.broadcast(long), items["record"].eqNullSafe(long["_r"]), "left")
    is_long = F.col("_r").isNotNull() | F.col("record").isNull()
    number = F.when(is_long, F.floor(F.col("pos") / cut) if block is None else block)
    lists = dealt.groupBy("record", is_long.alias("_long"), number.alias("_block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    single = lists.where("NOT _long").select("record", "items", F.lit(Decimal(total)).cast(kind).alias("left"))
    cuts = lists.where("_long")
    lefts = _left_before(cuts.select("record", "_block", F.transform("items", lambda i: i["amount"]).alias("amounts")), total, kind)
    lefts = lefts.select(F.col("record").alias("_r"), F.col("_block").alias("_b"), "left")
    passed = cuts.join(lefts, cuts["record"].eqNullSafe(lefts["_r"]) & cuts["_block"].eqNullSafe(lefts["_b"]))
    begun = single.unionByName(passed.select("record", "items", "left"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, i: Column) -> Column:
        fits = (acc["left"] > 0) & (i["amount"] <= acc["left"])
        return F.struct(F.when(fits, acc["left"] - i["amount"]).otherwise(acc["left"]).cast(kind).alias("left"), F.array_append(acc["taken"], fits).alias("taken"))

    folded = begun.select("record", "items", F.aggregate("items", start, step)["taken"].alias("taken"))
    rows = folded.select("record", F.explode(F.arrays_zip("items", "taken")).alias("r"))
    return rows.select("record", F.col("r.items.pos").alias("pos"), F.col("r.items.size").alias("size"), F.col("r.taken").alias("admitted"))
