"""Collision-free file names for a batch, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.names import name_key
from gleanery.plans.ordered import rank_in_key, sum_before
from gleanery.session import checkpoint_dir, ship_package

#: A title with a number that a batch can reach: more digits would take more records than there can be.
_NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,17})\)\z"
_ALWAYS = -1
#: Rivals of a base that are summarised in one row.
RIVALS = 256


def _parent(key: Column) -> Column:
    """``p`` and ``k`` when the name reads ``p (k)`` with k >= 2."""
    plain = key.cast("string")
    hit = plain.rlike(_NUMBERED)
    return F.when(
        hit, F.struct(F.regexp_extract(plain, _NUMBERED, 1).alias("p"), F.regexp_extract(plain, _NUMBERED, 2).cast("bigint").alias("k"))
    )


def _depth(key: Column) -> Column:
    """How many trailing `` (n)`` a name has."""
    tail = F.regexp_extract(key.cast("string"), r"((?: \((?:[2-9]|[1-9][0-9]{1,17})\))*)\z", 1)
    return F.size(F.split(tail, r"\(")) - 1


def skip_steps(limits: Column) -> Column:
    """What a block of rivals adds to the numbers skipped before it, as descending steps.

    A rival is skipped while fewer numbers than its limit are skipped so far.
    How many a block adds never grows with what was skipped before, so it is a
    step function: one more for each step above that count.  Each rival adds a
    step to those of the rivals before it: its limit, less the steps that lift
    the count over it.
    """

    def lowered(at: Column, step: Column) -> Column:
        return at - (step >= at).cast("bigint")

    def add(steps: Column, limit: Column) -> Column:
        one = F.aggregate(steps, limit, lowered)
        return F.concat(F.filter(steps, lambda x: x > one), F.array(one), F.filter(steps, lambda x: x <= one))

    return F.filter(F.aggregate(limits, F.array().cast("array<bigint>"), add), lambda x: x > 0)


def skipped_before(blocks: DataFrame) -> DataFrame:
    """``base, block, skipped``: numbers skipped before each block (``base, block, steps`` of :func:`skip_steps`).

    The blocks of a base pass one after the other, one row at a time.
    """
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, skipped = None, 0
        for batch in batches:
            out = []
            for base, steps in zip(batch.column("base").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                if base != here:
                    here, skipped = base, 0
                out.append(skipped)
                skipped += sum(x > skipped for x in steps)
            yield pa.RecordBatch.from_arrays([batch.column("base"), batch.column("block"), pa.array(out, pa.int64())], ["base", "block", "skipped"])

    ordered = blocks.select("base", "block", "steps").repartition("base").sortWithinPartitions("base", "block")
    return ordered.mapInArrow(run, "base bigint, block bigint, skipped bigint")


def unique_names(clips: DataFrame, existing: DataFrame, ext: str = ".md", cut: int = 100_000, rivals: int = RIVALS) -> DataFrame:
    """``id, file``: ``name``, ``name (2)``, ``name (3)`` … in order of ``seq``.

    ``clips``: ``id, seq, base``; ``existing``: ``file``.  A record takes the
    first number that is free, among existing names and names given earlier in
    the batch; case and composition are ignored.

    The greedy rule is solved from counts.  The r-th record of a base gets the
    r-th number that nobody else took before the base reached it.  Others are
    existing files, records whose own title reads ``name (k)`` and, for such a
    title, the base it is a number of.  Whether ``name (k)`` got there first
    depends only on how many records of the base arrived before it.  So the
    contested numbers are folded, never the records, in blocks of ``rivals``:
    each block is summarised by itself, the summaries give what was skipped
    before each block, and the blocks are then folded from there, so no row
    holds all rivals of a base.  Ranks and numbers come from block-wise running
    counts.
    """
    checkpoint_dir(clips.sparkSession)
    block = F.floor(F.col("seq") / cut)
    # names are compared once per different title; from there a key is a number
    seq_type, id_type = clips.schema["seq"].dataType, clips.schema["id"].dataType
    titles = clips.groupBy("base").agg(F.min("seq").alias("first_seq")).withColumn("key", name_key(F.col("base"))).checkpoint()
    bases = (
        titles.groupBy("key").agg(F.min("first_seq").alias("first_seq"))
        .select("first_seq", "key", F.monotonically_increasing_id().alias("no"), _depth(F.col("key")).alias("depth")).checkpoint()
    )
    numbered = titles.join(bases.select("key", "no"), "key").select("base", "no").checkpoint()
    items = clips.select("id", "seq", "base").join(numbered, "base")
    taken = existing.where(F.endswith("file", F.lit(ext))).select(
        name_key(F.regexp_replace("file", rf"{ext.replace('.', chr(92) + '.')}\z", "")).alias("key")
    ).distinct()

    # numbers of a base that somebody else may hold: (key, k, since)
    named = _parent(F.col("key"))
    held = taken.withColumn("s", named).where("s IS NOT NULL").select(name_key(F.col("s.p")).alias("key"), F.col("s.k").alias("k"), F.lit(None).cast(seq_type).alias("since"))
    plain = taken.select("key", F.lit(1).cast("bigint").alias("k"), F.lit(None).cast(seq_type).alias("since"))
    parents = bases.select(F.col("no").alias("child"), "depth", F.col("first_seq").alias("since"), named.alias("s")).where("s IS NOT NULL")
    rivals_of = parents.select(name_key(F.col("s.p")).alias("key"), F.col("s.k").alias("k"), "since", "child", "depth").join(bases.select("key", "no"), "key").drop("key").checkpoint()
    contested = (
        held.unionByName(plain).join(bases.select("key", "no"), "key").drop("key").unionByName(rivals_of.select("no", "k", "since"))
        .groupBy("no", "k")
        .agg(F.when(F.count("since") == F.count("*"), F.min("since")).alias("since"))
    ).checkpoint()
    # how many records of the base arrived before the rival did, and before each record
    marks = contested.where("since IS NOT NULL").select(
        F.lit(None).cast(id_type).alias("id"), F.col("since").alias("seq"), F.lit(None).cast("string").alias("base"), "no", "k", F.lit(0).alias("one")
    )
    counted = sum_before(
        items.select("id", "seq", "base", "no", F.lit(None).cast("bigint").alias("k"), F.lit(1).alias("one")).unionByName(marks),
        ["no"], ["seq"], block, F.col("one"), "before",
    ).select("id", "base", "no", "k", "before").checkpoint()
    since = counted.where("k IS NOT NULL").select("no", "k", "before")
    obstacles = contested.join(since, ["no", "k"], "left").select("no", "k", F.coalesce("before", F.lit(_ALWAYS)).cast("bigint").alias("before"))
    obstacles = obstacles.checkpoint()

    none = F.array().cast("array<bigint>")

    def step(acc: Column, o: Column) -> Column:
        skip = acc["s"] < o["limit"]
        return F.struct(
            (acc["s"] + skip.cast("bigint")).alias("s"),
            F.when(skip, F.array_append(acc["skipped"], o["k"])).otherwise(acc["skipped"]).alias("skipped"),
        )

    def solve(rows: DataFrame) -> DataFrame:
        """Numbers of each base that others hold.

        Those of existing files always are and only shift the ones above them;
        what is folded per base is the titles of this batch it competes with.
        """
        always = F.col("before") == _ALWAYS
        shifted = sum_before(rows, ["no"], ["k"], F.floor(F.col("k") / cut), F.when(always, 1).otherwise(0), "fixed")
        contest = shifted.where(~always).select("no", "k", (F.col("k") - F.col("fixed") - F.col("before")).alias("limit"))
        placed = rank_in_key(contest, ["no"], ["k"], F.floor(F.col("k") / cut), "n")
        lists = placed.groupBy(F.col("no").alias("base"), F.floor((F.col("n") - 1) / rivals).alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", "limit"))).alias("o"))
        lists = lists.checkpoint()
        starts = skipped_before(lists.select("base", "block", skip_steps(F.transform("o", lambda o: o["limit"])).alias("steps")))
        begun = lists.join(starts, ["base", "block"]).withColumn("start", F.struct(F.col("skipped").alias("s"), none.alias("skipped")))
        lost = begun.select(F.col("base").alias("no"), F.explode(F.aggregate("o", F.col("start"), step)["skipped"]).alias("k"))
        return lost.unionByName(rows.where(always).select("no", "k"))

    # a title ``p (k)`` finds its own name gone when p reached number k first
    deepest = bases.agg(F.max("depth")).first()[0] or 0
    skipped = None
    for depth in range(deepest + 1):
        rows = obstacles.join(bases.where(F.col("depth") == depth).select("no"), "no", "left_semi")
        if depth:
            child = rivals_of.where(F.col("depth") == depth).select("child", "no", "k")
            lost = child.join(obstacles.where(F.col("before") != _ALWAYS).select("no", "k"), ["no", "k"])
            lost = lost.join(skipped, ["no", "k"], "left_anti")
            own = lost.select(F.col("child").alias("no"), F.lit(1).cast("bigint").alias("k"), F.lit(_ALWAYS).cast("bigint").alias("before"))
            rows = rows.unionByName(own).dropDuplicates(["no", "k"])
        solved = solve(rows).checkpoint()
        skipped = solved if skipped is None else skipped.unionByName(solved)

    # the r-th free number is r plus the skipped ones below it
    ordered = counted.where("k IS NULL").select("id", "base", "no", (F.col("before") + 1).alias("r"))
    gaps = rank_in_key(skipped, ["no"], ["k"], F.floor(F.col("k") / cut), "j").select("no", (F.col("k") - F.col("j")).alias("r"), F.col("k").alias("tie")).checkpoint()
    ends = gaps.groupBy("no").agg(F.max("r").alias("last"), F.count("*").alias("gaps"))
    # above the last gap of its key a record has them all below it
    met = ordered.join(ends, "no", "left").withColumn("beyond", F.coalesce(F.col("r") > F.col("last"), F.lit(True)))
    above = met.where("beyond").select("id", "base", (F.col("r") + F.coalesce("gaps", F.lit(0))).alias("number"))
    # a gap counts for ranks above its own: order it after the record of equal rank
    ranked = met.where("NOT beyond").select("no", "r", F.lit(-1).alias("late"), F.lit(0).cast("bigint").alias("tie"), F.lit(0).alias("one"), "id", "base")
    between = gaps.select("no", "r", F.lit(0).alias("late"), "tie", F.lit(1).alias("one"), F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("base"))
    shifted = sum_before(ranked.unionByName(between), ["no"], ["r", "late", "tie"], F.floor(F.col("r") / cut), F.col("one"), "shift")
    below = shifted.where("one = 0").select("id", "base", (F.col("r") + F.col("shift")).alias("number"))
    named_file = F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("number").cast("string"), F.lit(")")))
    return above.unionByName(below).select("id", F.concat(named_file, F.lit(ext)).alias("file"))
