"""Merge overlapping ordered observations of one list into one order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.plans.ordered import last_before, next_row
from gleanery.session import checkpoint_dir, scratch_path, ship_package

#: Places of a run, or siblings, that are numbered in one task.
BLOCK = 4096
#: Tokens of linked lists, about, whose links are followed in one task.
LINKED = 1 << 17


def list_ranks(tokens: DataFrame) -> DataFrame:
    """``token, before`` of linked lists: the summed weight of what precedes each token in its list.

    ``tokens``: ``head, token, next, weight``; ``head`` names the list, ``next``
    is NULL at its end.  Pointer jumping: each round a token takes over the sum
    and the pointer of the token it points to, so the distance doubles and a
    row stays as long as it was.  A round has no more tasks than a shuffle has
    partitions: what the driver keeps of them does not grow from round to round.
    Tokens and those that point to them meet in a window, not in a join: a
    join's estimated size is a product, a number of twice the digits each round.
    """
    partitions = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = tokens.groupBy("head").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    state = tokens.select("head", "token", "next", F.col("weight").alias("rest")).coalesce(partitions).checkpoint()
    reach = 1
    while reach < sizes:
        # a token that has reached the end stays as it is; only the others look ahead
        asks = state.where("next IS NOT NULL").select("head", "token", F.col("next").alias("_key"), F.col("rest").alias("_own"), *(F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("next", "rest")))
        answers = state.select(*(F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("head", "token")), F.col("token").alias("_key"), F.lit(None).cast("bigint").alias("_own"), "next", "rest")
        met = Window.partitionBy("_key")
        ahead = asks.unionByName(answers).withColumns({c: F.max(c).over(met) for c in ("next", "rest")})
        moving = ahead.where("_own IS NOT NULL").select("head", "token", "next", (F.col("rest") + F.col("_own")).alias("rest"))
        state = moving.unionByName(state.where("next IS NULL")).coalesce(partitions).checkpoint()
        reach *= 2
    totals = tokens.groupBy("head").agg(F.sum("weight").alias("_total"))
    return state.join(totals, "head").select("token", (F.col("_total") - F.col("rest")).alias("before"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pieces(links: pa.Table) -> pa.Table:
    """The pieces of lists that links within one block make: per token the piece's first token and the weight before it there.

    The first token also has what the piece is as a whole: its ``head``, the
    token that follows it in another block, and its weight.
    """
    at = links.column("at").to_numpy()
    n, base, order = len(at), at.min(), np.argsort(at)
    to, weight = links.column("to").fill_null(-1).to_numpy()[order], links.column("weight").to_numpy()[order]
    own = np.arange(n)
    inside = (to >= base) & (to < base + n)
    first, before = own.copy(), np.zeros(n, np.int64)
    first[to[inside] - base] = own[inside]
    before[to[inside] - base] = weight[inside]
    for _ in range(n.bit_length()):  # each round looks twice as far back
        before += before[first]
        first = first[first]
    last = own[~inside]
    follows, whole = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    follows[first[last]], whole[first[last]] = to[last], before[last] + weight[last]
    none = first != own
    heads = pc.if_else(pa.array(none), pa.scalar(None, links.schema.field("head").type), links.column("head").combine_chunks().take(pa.array(order)))
    columns = [pa.array(base + own), pa.array(base + first), pa.array(before), heads, pa.array(follows, mask=none | (follows < 0)), pa.array(whole, mask=none)]
    return pa.Table.from_arrays(columns, ["at", "piece", "offset", "head", "next", "weight"])


def with_ranks(tokens: DataFrame, linked: int = LINKED) -> DataFrame:
    """``tokens`` of linked lists with ``before``, the summed weight of what precedes each in its list.

    As :func:`list_ranks`, with other columns kept, and less for it to do:
    tokens are numbered in their order and cut into blocks, in which a task
    follows all links.  What is left is a list of pieces.  Where neighbours of
    a list are near in the order of tokens, there are few; where they are not,
    there are as many as tokens, and the result is the same.
    """
    ship_package()
    blocks = -(-tokens.count() // linked) or 1
    numbered = _kept(tokens.repartitionByRange(blocks, "token").sortWithinPartitions("token").withColumn("_at", F.monotonically_increasing_id()), "numbered-tokens")
    link = ["head", F.col("_at").alias("at"), "weight"]
    targets = numbered.select(F.col("token").alias("next"), F.col("_at").alias("to")).hint("merge")
    links = numbered.where("next IS NOT NULL").select(*link, "next").join(targets, "next").drop("next").unionByName(numbered.where("next IS NULL").select(*link, F.lit(None).cast("bigint").alias("to")))
    schema = f"at bigint, piece bigint, offset bigint, head {numbered.schema['head'].dataType.simpleString()}, next bigint, weight bigint"
    pieces = _kept(links.withColumn("weight", F.col("weight").cast("bigint")).groupBy(F.shiftright("at", 33).alias("block")).applyInArrow(_pieces, schema), "pieces")
    ranks = list_ranks(pieces.where("at = piece").select("head", F.col("piece").alias("token"), "next", "weight"))
    placed = pieces.select("at", "piece", "offset").join(ranks.select(F.col("token").alias("piece"), F.col("before").alias("_before")).hint("merge"), "piece")
    placed = placed.select(F.col("at").alias("_at"), (F.col("_before") + F.col("offset")).alias("before"))
    return numbered.join(placed.hint("merge"), "_at").drop("_at")


def thread_merge(cells: DataFrame) -> DataFrame:
    """Posts of each list in merged order, with their latest state.

    ``cells``: ``list_id, snapshot_no, pos, kind, id, handle``.  A post first
    seen in a snapshot goes after the nearest post before it there, else before
    the nearest known post after it, else to the end of the list.

    Where a post goes depends only on what is next to it in the snapshot that
    introduces it, not on the order built so far.  So the merge is a tree of
    runs of new posts: a run hangs in its parent run at a cut between two of
    its posts; of those in one cut, runs that follow a post come first, later
    snapshots nearer to it, and then those that precede the next post, earlier
    snapshots first.  The tour of this tree is a linked list with two rows per
    run: its posts up to the first run that hangs in it, and its parent's posts
    after it.  :func:`with_ranks` counts the posts before each such stretch.
    Rows are of constant size, however deep the tree is, and no list is in one
    task.
    """
    checkpoint_dir(cells.sparkSession)
    at = F.struct("snapshot_no", "pos")
    screen = Window.partitionBy("list_id", "snapshot_no").orderBy("pos")
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    is_post = F.col("kind") == "post"

    firsts = cells.where(is_post).groupBy("list_id", "id").agg(F.min(at).alias("_first"))
    placed = cells.join(firsts.hint("merge"), ["list_id", "id"], "left").withColumns(
        {
            "_new": F.coalesce(F.col("_first") == at, F.lit(False)),
            "_known": is_post & (F.col("_first.snapshot_no") < F.col("snapshot_no")),
        }
    )
    seen = placed.withColumns(
        {
            "_above": F.lag("kind").over(screen),
            "_prev": F.last(F.when(is_post, F.struct("id", "_new")), True).over(screen.rowsBetween(*before)),
            "_next": F.first(F.when(F.col("_known"), F.col("id")), True).over(screen.rowsBetween(*after)),
        }
    )
    opens = F.col("_new") & ~F.coalesce(F.col("_prev._new"), F.lit(False))
    runs_in = seen.withColumn("_run", F.sum(F.when(opens, 1).otherwise(0)).over(screen.rowsBetween(Window.unboundedPreceding, 0)))
    offset = F.row_number().over(Window.partitionBy("list_id", "snapshot_no", "_run").orderBy("pos")).cast("bigint")
    run = F.struct("list_id", "snapshot_no", F.col("_run").alias("run_no"))
    new = runs_in.where("_new").withColumns({"offset": offset, "run": run})
    items = new.select("list_id", "run", "id", "offset", F.coalesce("_prev.id", "_next").alias("anchor"), F.col("_prev").isNotNull().alias("follows"))
    items = items.checkpoint()

    runs = _hung(items)
    stretches = with_ranks(_kept(_tour(runs), "tokens")).select("run", "cut", "side", "nth", "before")
    # the stretch a post is in is the last one that starts before it
    none = F.lit(None).cast("bigint")
    rows = items.select("list_id", "run", "id", "offset", F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("nth"), none.alias("from"))
    starts = stretches.select(F.col("run.list_id").alias("list_id"), "run", F.lit(None).cast(items.schema["id"].dataType).alias("id"), F.col("cut").alias("offset"), F.col("side"), "nth", (F.col("before") - F.col("cut")).alias("from"))
    # a post is after everything that hangs in a lower cut, and before what hangs right behind it
    order = [F.col("offset") * 2 + F.when(F.col("id").isNull(), 1).otherwise(0), F.col("side"), F.col("nth")]
    every = rows.unionByName(starts).withColumns({f"_o{i}": o for i, o in enumerate(order)})
    found = last_before(every, ["run"], ["_o0", "_o1", "_o2"], F.floor(F.col("_o0") / BLOCK), F.col("from"), "_from")
    positions = found.where("id IS NOT NULL").select("list_id", "id", (F.col("_from") + F.col("offset")).alias("position"))
    # the break flag is known only where something stands above the post
    latest = seen.where(is_post).groupBy("list_id", "id").agg(
        F.max_by("handle", at).alias("handle"),
        F.coalesce(
            F.max_by(F.col("_above") != "post", F.when(F.col("_above").isNotNull(), at)), F.lit(False)
        ).alias("break_before"),
    )
    return positions.join(latest, ["list_id", "id"]).select("list_id", "position", "id", "handle", "break_before")


def _hung(items: DataFrame) -> DataFrame:
    """One row per run: ``run, size``, and where it hangs: ``parent, cut, side, nth`` (a top run: parent NULL).

    ``side`` is 0 for a run that follows a post and 1 for one that precedes
    one; ``nth`` orders those of one cut and side.
    """
    sizes = items.groupBy("list_id", "run").agg(F.max("offset").alias("size"), F.max(F.when(F.col("offset") == 1, F.col("anchor"))).alias("anchor"), F.bool_or((F.col("offset") == 1) & F.col("follows")).alias("follows"))
    anchors = items.select("list_id", F.col("id").alias("anchor"), F.col("run").alias("parent"), F.col("offset").alias("hook"))
    snap = F.col("run.snapshot_no").cast("bigint")
    follows = F.col("follows") & F.col("parent").isNotNull()
    return sizes.join(anchors.hint("merge"), ["list_id", "anchor"], "left").select(
        "run",
        "size",
        "parent",
        F.when(F.col("parent").isNull(), F.lit(0).cast("bigint")).when(follows, F.col("hook")).otherwise(F.col("hook") - 1).alias("cut"),
        F.when(follows, 0).otherwise(1).alias("side"),
        F.when(follows, -snap).otherwise(snap).alias("nth"),
    )


def _tour(runs: DataFrame) -> DataFrame:
    """The linked list of all stretches, two per run.

    Token ``(run, 0)`` is the run's posts up to the first run that hangs in it;
    token ``(run, 1)`` is the parent's posts from where the run hangs to the
    next one.  ``run, cut, side, nth`` say where in which run a stretch starts.
    """
    token = lambda r, end: F.struct(r.alias("run"), F.lit(end).alias("end"))
    # top runs hang in a run of the list itself that has no posts
    up = F.coalesce(F.col("parent"), F.struct(F.col("run.list_id").alias("list_id"), F.lit(None).cast(runs.schema["run"].dataType["snapshot_no"].dataType).alias("snapshot_no"), F.lit(-1).cast(runs.schema["run"].dataType["run_no"].dataType).alias("run_no")))
    hung = runs.withColumn("_up", F.struct(up["list_id"].alias("list_id"), F.coalesce(up["snapshot_no"].cast("bigint"), F.lit(-1)).alias("snapshot_no"), up["run_no"].alias("run_no")))
    block: Column = F.struct("cut", "side", F.floor(F.col("nth") / BLOCK))
    sibling = next_row(hung, ["_up"], ["cut", "side", "nth"], block, F.struct("run", "cut"), "_sibling")
    first = hung.where("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct("cut", "side", "nth", "run")).alias("_child")).withColumnRenamed("parent", "run")
    with_first = sibling.join(first, "run", "left")
    of_parent = runs.select(F.col("run").alias("parent"), F.col("size").alias("_parent_size"))
    rows = with_first.join(of_parent, "parent", "left")
    start = F.struct(
        token(F.col("run"), 0).alias("token"),
        F.when(F.col("_child").isNotNull(), token(F.col("_child.run"), 0)).otherwise(token(F.col("run"), 1)).alias("next"),
        F.coalesce("_child.cut", "size").alias("weight"),
        F.col("run").alias("run"), F.lit(0).cast("bigint").alias("cut"), F.lit(-1).alias("side"), F.lit(0).cast("bigint").alias("nth"),
    )
    behind = F.struct(
        token(F.col("run"), 1).alias("token"),
        F.when(F.col("_sibling").isNotNull(), token(F.col("_sibling.run"), 0)).when(F.col("parent").isNotNull(), token(F.col("parent"), 1)).alias("next"),
        F.when(F.col("parent").isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce("_sibling.cut", "_parent_size") - F.col("cut")).alias("weight"),
        F.col("parent").alias("run"), F.col("cut").alias("cut"), F.col("side").alias("side"), F.col("nth").alias("nth"),
    )
    return rows.select(F.col("run.list_id").alias("head"), F.explode(F.array(start, behind)).alias("t")).select("head", "t.*")
