"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import ship, texts, worker_for, written
from gleanery.llm.words import slices, word_ids
from gleanery.plans.ordered import rank_in_key

CAPACITY = 4096
#: The id that ends every document.
END_ID = 1


class Run(NamedTuple):
    """Slots for the pieces of one length and ranks ``first <= rank < beyond``.

    Each sequence from ``sequence`` on takes ``each`` of them in turn, gapless
    from ``offset``.
    """

    length: int
    first: int
    beyond: int
    each: int
    sequence: int
    offset: int


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit, longest first, over counts of lengths.

    Sequences with the same room left are kept as intervals of numbers, so a
    step places all pieces of a length that go to one interval at once.  Time
    and size depend on the capacity, not on how many pieces there are.
    """
    runs: list[Run] = []
    rooms: list[int] = []
    open_at: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def put(room: int, lo: int, hi: int) -> None:
        if room and lo < hi:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((lo, hi))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        while rank < count:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                lo, hi, room = used, used + -(-(count - rank) // each), capacity
                used = hi
            else:
                room = rooms[i]
                lo, hi = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[i]
                each = room // length
            take = min(count - rank, (hi - lo) * each)
            full, part = divmod(take, each)
            runs.append(Run(length, rank, rank + take, each, lo, capacity - room))
            put(room - each * length, lo, lo + full)
            put(room - part * length, lo + full, lo + full + (part > 0))
            put(room, lo + full + (part > 0), hi)
            rank += take
    return runs


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document's pieces.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is
    cut, into pieces of ``capacity`` and a rest.
    """
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("words")
        close = end_id.to_bytes(4, "little")
        step = 4 * capacity
        for batch in batches:
            for part in slices(batch, "text"):
                split = [t.split() for t in part.column("text").cast(pa.binary()).to_pylist()]
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, found in enumerate(word_ids(path, split)):
                    found.append(close)
                    ids = b"".join(found)
                    for k, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at : at + step]
                        row.append(i)
                        piece.append(k)
                        start.append(at >> 2)
                        length.append(len(cut) >> 2)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            kept.append(cut)
                out = [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.binary())] if with_ids else [])], [*names, *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def slots(spark: SparkSession, runs: list[Run]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in runs], "length long, _first long, _beyond long, _each long, _sequence long, _offset long")


def packed(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, blocks: int | None = None) -> DataFrame:
    """Every piece with its place: ``sequence_id, offset`` beside the columns of :func:`pieces`.

    The histogram of lengths, at most ``capacity`` rows, is planned by
    :func:`plan_best_fit`; pieces take the planned slots by joining on their
    rank within their length.  Ranks are counted in ``blocks`` of each length,
    so a frequent length is many tasks' work.

    NULL text is empty: one piece with the end id alone.  Rows are documents of
    their own, so repeated rows are packed each; other columns are left out; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = slots(spark, plan_best_fit(histogram, capacity))
    if blocks is None:
        blocks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    ranked = rank_in_key(cut, ["length"], ["doc_id", "piece", "ids_crc32"], block, "_rank").withColumn("_rank", F.col("_rank") - 1)
    # the plan's size depends on the capacity alone
    at = ranked.join(F.broadcast(runs), "length").filter("_first <= _rank AND _rank < _beyond")
    k = F.col("_rank") - F.col("_first")
    place = F.col("_sequence") + F.floor(k / F.col("_each")).cast("long")
    return at.select(*cut.columns, place.alias("sequence_id"), (F.col("_offset") + (k % F.col("_each")) * F.col("length")).alias("offset"))
