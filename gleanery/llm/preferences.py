"""Preference pairs from chosen and rejected conversations (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed values of the template: what opens and closes a turn.
OPEN, BODY, CLOSE = "<|", "|>\n", "\n<|end|>\n"
#: Turns of this role are what the model learns.
LEARNED = "assistant"

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
SPANS = "array<struct<start:int,end:int>>"


def _turns(side: DataFrame, name: str) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    return side.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(BODY))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """``[start, end)`` in code points of the completion, per learned turn: its text and closing mark."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.when(t["role"] == LEARNED, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(SPANS))
        return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per ``pair_id`` of either side.

    Both sides have ``pair_id, turn, role, text``.  The longest common prefix
    of turns, equal in role and text, is rendered once as ``prompt``; the rest
    of either side is its completion, and the spans of its mask are what counts
    in training (all else has weight zero).  Returns ``pair_id, common_turns,
    prompt, chosen, chosen_mask, rejected, rejected_mask, usable``; ``usable``
    says that both completions hold something to learn and differ.

    Turns are ordered by ``turn``, then role and text, so ties have one order;
    repeated rows are repeated turns.  NULL role and text are empty, a NULL turn
    comes first; rows without a pair id are left out.  A side without rows is a
    conversation of no turns.  Other columns are ignored.
    """
    none = F.array().cast(TURNS)
    sides = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id", "full_outer")
    sides = sides.select("pair_id", F.coalesce(F.col("c").cast(TURNS), none).alias("c"), F.coalesce(F.col("r").cast(TURNS), none).alias("r"))
    differs = F.zip_with("c", "r", lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])) | a.isNull() | b.isNull())
    # a missing turn of the shorter side differs, so the first difference bounds the prefix
    first = F.array_position(differs, F.lit(True))
    common = F.when(first == 0, F.size("c")).otherwise(first - 1).cast("int")
    rows = sides.select("pair_id", "c", "r", common.alias("common_turns"))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("common_turns") + 1, F.greatest(F.size(side), F.lit(1)))

    rows = rows.select("pair_id", "common_turns", F.slice("c", 1, F.col("common_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    learns = lambda side: F.exists(side, lambda t: t["role"] == LEARNED)
    return rows.select(
        "pair_id", "common_turns", _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
        (learns("c") & learns("r")).alias("usable"),
    )


def neighbours(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides out of one table: conversation 2k is chosen over 2k + 1, as pair k."""
    sides = conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), "turn", "role", "text", F.pmod("conv_id", F.lit(2)).alias("_odd"))
    return sides.filter("_odd = 0").drop("_odd"), sides.filter("_odd = 1").drop("_odd")
