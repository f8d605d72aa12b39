"""Cut long texts into pieces an engine can take, and join them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.language import api_tag
from gleanery.functions.text import let, trim_ws

#: Longest piece, in characters.
MAX_PIECE = 2000
SENTENCES = r"(?s)[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+\z"


def _pack(units: Column, limit: int) -> Column:
    """Indexes (from 1) of the units that open a new piece, greedily."""
    start = F.struct(
        F.lit(1).alias("i"), F.lit(0).alias("open"), F.array(F.lit(1)).alias("starts")
    )

    def step(acc: Column, unit: Column) -> Column:
        size = F.length(unit)
        fits = acc["open"] + size <= limit
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(fits, acc["open"] + size).otherwise(size).alias("open"),
            F.when(fits, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["i"])).alias("starts"),
        )

    return F.aggregate(units, start, step)["starts"]


def pieces_of(text: Column, limit: int = MAX_PIECE) -> Column:
    """Greedy sentence packing; the pieces joined give the text back.

    A sentence longer than the limit is cut into slices first; packing then
    closes a piece before each full slice and leaves the last one open.
    """

    def slices(sentence: Column) -> Column:
        cut = F.regexp_extract_all(sentence, F.lit(rf"(?s).{{1,{limit}}}"), 0)
        return F.when(F.length(sentence) > limit, cut).otherwise(F.array(sentence))

    units = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SENTENCES), 0), slices))

    def join(u: Column) -> Column:
        def cut(starts: Column) -> Column:
            ends = F.array_append(F.slice(starts, 2, 1 << 30), F.size(u) + 1)
            spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
            return F.transform(spans, lambda s: F.array_join(F.slice(u, s["a"], s["b"] - s["a"]), ""))

        return let(_pack(u, limit), cut)

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(let(units, join))


def chunk_documents(docs: DataFrame, limit: int = MAX_PIECE) -> DataFrame:
    """Pieces per document; all inside the row, so nothing is shuffled."""
    return docs.select("doc_id", F.posexplode(pieces_of(F.col("text"), limit)).alias("chunk_no", "text"))


def join_chunks(chunks: DataFrame, target: Column) -> DataFrame:
    """Trim and join the pieces of a document in order.

    The separator is one space, or none for targets written without spaces.
    What meets here is one document, which was one row before the cut.
    """
    separator = F.when(api_tag(target).isin("zh", "zh-Hant", "ja"), "").otherwise(" ")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", trim_ws(F.col("text")).alias("t")))), lambda p: p["t"])
    joined = chunks.groupBy("doc_id").agg(parts.alias("parts"), F.first(separator).alias("sep"))
    text = F.when(F.col("sep") == "", F.array_join("parts", "")).otherwise(F.array_join("parts", " "))
    return joined.select("doc_id", text.alias("text"))
