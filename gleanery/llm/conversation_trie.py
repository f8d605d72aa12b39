"""Prefix trie of conversations: whole sequences collapsed first, weighted prefixes aggregated after."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import ship, worker_for, written

#: Conversations of one block start alike; by how many turns is told by the id modulo HEADS.
BLOCK, HEADS = 100, 6
#: The node of no turns.
ROOT = bytes(16)
#: Characters of a list of ids that are one row.
CHUNK = 1 << 16


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_id, length``: turns numbered from 1, told apart by 128 bits of a SHA-256 over role and text.

    Order is ``turn`` (NULL first), ties by role and text; repeated rows are
    repeated turns; NULL role and text are empty.  Rows without a conversation
    id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    name = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256), 1, 32))
    return written(rows.select("conv_id", F.row_number().over(order).alias("pos"), name.alias("turn_id"), F.length("text").cast("long").alias("length")), "turns")


def with_roots(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``turns`` and a row at ``pos`` 0 for each conversation, so one without turns is not lost."""
    return turns.unionByName(ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("long").alias("length")))


def rebuilt(turns: DataFrame, *, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """The turns of :func:`ordered_turns` with shared beginnings, and the roots.

    Conversation c takes the first h turns of the conversation that opens its
    block (``c - c % block``; all if it has fewer, none if there is none) and
    then its own beyond the h-th, where h is the CRC-32 of its decimal id
    modulo ``heads``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    ids = turns.select("conv_id").distinct()
    own = turns.filter(F.col("pos") > h)
    opening = turns.filter((F.col("conv_id") % block == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "_base")
    taken = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("_of"), h.alias("_h"))
    taken = taken.join(opening, (F.col("_of") == F.col("_base")) & (F.col("pos") <= F.col("_h"))).select(*turns.columns)
    return with_roots(own.unionByName(taken), ids)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, length, ends`` per conversation and depth.

    A node is named by a chained 128-bit hash of the turns up to it.  A task
    reads its conversations turn by turn from a sorted partition and holds one
    node, however long the conversation is.
    """
    ship()
    names = ["conv_id", "depth", "node", "parent", "length", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("trie")
        last = None
        for batch in batches:
            out = []
            for conv, turn, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_id", "length")), strict=True):
                if last is not None:
                    out.append((*last, last[0] != conv))
                if turn is None:
                    last = (conv, 0, ROOT, None, 0)
                else:
                    last = (conv, last[1] + 1, hashlib.blake2b(last[2] + turn, digest_size=16).digest(), last[2], length)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*last, True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    ordered = turns.select("conv_id", "pos", "turn_id", "length").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, length long, ends boolean")


def end_lists(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the digest of the ids (``conv_id``) at each node, rising and joined by commas.

    Ids are range-partitioned by node and id and become chunks of the list in
    parallel; one task then hashes a node's chunks in order and holds one.
    """
    ship()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size = None, [], 0

        def row() -> pa.RecordBatch:
            some = [] if here is None else [here]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(held[:1], pa.int64()), pa.array([",".join(map(str, held))] if some else [], pa.string())], ["node", "first", "ids"])

        for batch in batches:
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if node != here or size >= CHUNK:
                    yield row()
                    here, held, size = node, [], 0
                held.append(conv)
                size += 12
        yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            nodes, found = [], []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != here:
                    if here is not None:
                        nodes.append(here)
                        found.append(state.hexdigest())
                    here, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    parts = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, "node binary, first long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations in ``turns`` (of :func:`with_roots`), the empty one included.

    Identical conversations are one weighted sequence; a sequence that is a
    proper prefix of another is no leaf.  Nodes are the prefixes of the
    sequences, their counts sums of weights.  For sums over subtrees each node
    counts once, at its least leaf: such a leaf's own nodes are the lower end of
    its path, so the running sum from the leaf upwards is what it adds to each
    of its ancestors.  Every row of these steps is one node of one distinct
    sequence.

    Columns: ``node, parent``, the smallest member ``conv_id``, ``depth``, the
    parent's ``parent_conv_id``, ``n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.
    """
    paths = written(prefixes(turns), "conversation-paths")
    ends = paths.filter("ends").select("node", "conv_id")
    sequences = written(ends.groupBy("node").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight")), "sequences")
    steps = paths.join(sequences.select("seq", "weight"), F.col("conv_id") == F.col("seq")).select("seq", "weight", "depth", "node", "parent", "length", "ends")
    steps = written(steps, "sequence-paths")
    inner = steps.filter("NOT ends").select("node").distinct()
    leaves = sequences.join(inner, "node", "left_anti").select(F.col("seq").alias("leaf"))
    marked = written(steps.join(leaves, F.col("seq") == F.col("leaf"), "left"), "marked-paths")
    nodes = marked.groupBy("node", "parent", "depth", "length").agg(F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.count("leaf").alias("n_leaves"), F.min("leaf").alias("leaf"))
    nodes = written(nodes, "trie-nodes")
    saved = nodes.select("leaf", "depth", F.lit(None).cast("binary").alias("node"), ((F.col("n_convs") - 1) * F.col("length")).alias("saved"))
    way = marked.filter("leaf IS NOT NULL").select("leaf", "depth", "node", F.lit(0).cast("long").alias("saved"))
    upwards = Window.partitionBy("leaf").orderBy(F.col("depth").desc(), F.col("node").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sums = way.unionByName(saved).select("node", F.sum("saved").over(upwards).alias("saved"), F.lit(0).cast("long").alias("child")).filter("node IS NOT NULL")
    children = nodes.filter("depth > 0").select(F.col("parent").alias("node"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("child"))
    tally = sums.unionByName(children).groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("child").alias("n_children"))
    above = nodes.select(F.col("node").alias("_above"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("leaf").join(tally, "node").join(end_lists(ends), "node", "left").join(above, F.col("parent") == F.col("_above"), "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of a table of turns (``conv_id, turn, role, text``) as it is.

    Ties of ``turn`` are ordered by role and text; NULL role and text are empty;
    repeated rows are repeated turns; rows without ``conv_id`` and other columns
    are left out; an empty table gives no rows, not even the root.
    """
    turns = ordered_turns(conversations)
    return prefix_trie(with_roots(turns, turns.select("conv_id").distinct()))


def rebuilt_trie(conversations: DataFrame, *, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """:func:`prefix_trie` of the conversations of :func:`rebuilt`; rows are treated as in :func:`conversation_trie`."""
    return prefix_trie(rebuilt(ordered_turns(conversations), block=block, heads=heads))
