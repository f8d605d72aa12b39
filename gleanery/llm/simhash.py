"""Near-duplicate classes by SimHash: an inverted index of byte positions with count filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import ship, texts, worker_for, written
from gleanery.llm.graph import components
from gleanery.llm.words import slices

WIDTH, MAX_BITS = 3, 3
#: Fixed value of the contract: seed of the shingle hash.
SEED = 42
#: Bytes of a fingerprint.
POSITIONS = 8
#: Positional bytes of a posting's key.
SHARED = 4
#: Members of a posting list that meet in one task.
BLOCK = 1024
#: Runs into which the rows of one fingerprint are dealt at most.
RUNS = 256

U = np.uint64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def stretches(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """Parts of a text of about ``most`` bytes, cut at white space."""
    start = 0
    while start < len(data):
        cut = _BLANK.search(data, start + most)
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; fewer words are one shingle, none give none."""
    import xxhash

    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    words: list[bytes] = []
    out = []
    for part in stretches(data.lower()):
        words = words + part.split() if words else part.split()
        n = len(words) - width + 1
        if n > 0:
            out.append(np.fromiter(map(hashed, map(b" ".join, zip(*(words[k : k + n] for k in range(width)), strict=True))), U, n))
            words = words[n:]
    if not out and words:
        out.append(np.array([hashed(b" ".join(words))], U))
    return np.concatenate(out) if out else np.zeros(0, U)


def majority(hashes: list[np.ndarray], step: int = 1 << 16) -> np.ndarray:
    """The fingerprint of each array: bits set in over half of its hashes."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    every = np.concatenate(hashes) if hashes else np.zeros(0, U)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    ones = np.zeros((len(hashes), 64), np.int64)
    for k in range(0, len(every), step):
        bits = np.unpackbits(every[k : k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = owner[k : k + step]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``doc_id, print`` (64 bits as a long) per row; a text without words has print 0."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("simhash")
        for batch in batches:
            for part in slices(batch, "text"):
                made = majority([shingle_hashes(t, width) for t in part.column("text").cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, print long")


def postings(prints: DataFrame, max_bits: int, shared: int) -> DataFrame:
    """``key, print``: the inverted index on ``shared`` positional bytes at a time.

    Prints that differ in ``max_bits`` bits differ in as many bytes at most, so
    of any ``max_bits + shared`` positions they share ``shared``: the first so
    many positions are enough, in every choice of ``shared`` of them.
    """
    byte = [F.expr(f"shiftrightunsigned(print, {8 * i}) & 255L") for i in range(POSITIONS)]
    keys = []
    for number, chosen in enumerate(combinations(range(max_bits + shared), shared)):
        key: Column = F.lit(number).cast("long")
        for i in chosen:
            key = key * 256 + byte[i]
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "print")


def shared_bytes(a: str, b: str) -> Column:
    """Positions at which two prints have the same byte."""
    return sum((F.expr(f"int((shiftrightunsigned({a} ^ {b}, {8 * i}) & 255L) = 0)") for i in range(POSITIONS)), F.lit(0))


def near(a: str, b: str, max_bits: int) -> Column:
    """Enough shared positional bytes, and then few enough differing bits."""
    return (shared_bytes(a, b) >= POSITIONS - max_bits) & (F.expr(f"bit_count({a} ^ {b})") <= max_bits)


def _joined_in_cell(prints: np.ndarray, labels: np.ndarray, seeks: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links between prints of different labels, no more than join those labels; each pair has a seeker."""
    group = {x: x for x in labels.tolist()}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for i in np.flatnonzero(seeks).tolist():
        differs = prints ^ prints[i]
        tally = np.count_nonzero(differs.view(np.uint8).reshape(-1, POSITIONS) == 0, axis=1)
        at = np.flatnonzero((tally >= POSITIONS - max_bits) & (labels != labels[i]))
        at = at[np.bitwise_count(differs[at]) <= max_bits]
        for label, first in zip(*np.unique(labels[at], return_index=True), strict=True):
            mine, other = root(int(labels[i])), root(int(label))
            if mine != other:
                group[other] = mine
                out.append((i, int(at[first])))
    return out


def linked_in_blocks(members: DataFrame, *, max_bits: int, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between members of one posting list that have different labels, all such pairs considered.

    ``members`` has ``key, print, label``.  Members of a list's most frequent
    label stay in blocks of their own; the others go to every block of the
    list.  A task holds one block against another, and gives no more links
    than join the labels it sees.
    """
    ship()
    per = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("_most"), F.sum("n").alias("_all"), F.max("n").alias("_main"))
    rows = members.join(most.hint("merge"), "key").withColumn("seeks", F.col("label") != F.col("_most"))
    mains, seekers = F.ceil(F.col("_main") / block), F.ceil((F.col("_all") - F.col("_main")) / block)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("print", "key"), F.when(F.col("seeks"), seekers).otherwise(mains)))

    def cells(n: Column, cell) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), cell)

    mine = F.concat(
        cells(mains, lambda m: F.struct(F.col("_own").alias("x"), (-m - 1).alias("y"))), cells(seekers, lambda s: F.struct(F.least("_own", s).alias("x"), F.greatest("_own", s).alias("y")))
    )
    theirs = cells(seekers, lambda s: F.struct(s.alias("x"), (-F.col("_own") - 1).alias("y")))
    rows = rows.select("key", "print", "label", "seeks", F.explode(F.when(F.col("seeks"), mine).otherwise(theirs)).alias("c"))
    rows = rows.select("key", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "seeks", "print", "label").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("simhash")
        here, held = None, []

        def done() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(3)] if held else [np.zeros(0, np.int64)] * 3
            prints = columns[0].view(U)
            found = _joined_in_cell(prints, columns[1], columns[2], max_bits)
            sides = [pa.array(prints[[p[i] for p in found]].view(np.int64) if found else [], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(sides, ["a", "b"])

        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")])
            data = [np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("print", "label", "seeks")]
            edges = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                now = tuple(cell[:, lo].tolist())
                if now != here:
                    yield done()
                    here, held = now, []
                held.append([d[lo:hi] for d in data])
        yield done()

    return rows.mapInArrow(run, "a long, b long")


def print_labels(prints: DataFrame, *, max_bits: int = MAX_BITS, shared: int = SHARED, block: int = BLOCK) -> DataFrame | None:
    """``node, label`` of every print (column ``print``, distinct) that links to a smaller one; None if none does.

    Each posting list is first compared with its smallest print, then what lies
    in different groups of one list in blocks.  Joins of lists say that they
    sort and merge: the planner takes postings to be no more bytes than the
    prints they come from, and a file of them to be as small in memory.
    """
    index = postings(prints, max_bits, shared)
    lists = index.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("print").alias("pivot")).filter("_n > 1").drop("_n")
    members = written(index.join(lists.hint("merge"), "key"), "posting-lists")
    links = members.filter(F.col("print") != F.col("pivot")).filter(near("print", "pivot", max_bits)).select(F.col("print").alias("a"), F.col("pivot").alias("b")).distinct()
    links = written(links, "links")
    labels = None if links.isEmpty() else components(links)
    rows = members.select("key", "print")
    if labels is None:
        rows = rows.withColumn("label", F.col("print"))
    else:
        rows = rows.join(labels, rows["print"] == labels["node"], "left").select("key", "print", F.coalesce("label", "print").alias("label"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("key")
    more = written(linked_in_blocks(written(rows.join(mixed, "key"), "open-lists"), max_bits=max_bits, block=block), "links")
    if more.isEmpty():
        return labels
    return components(more if labels is None else more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def simhash_classes(docs: DataFrame, *, width: int = WIDTH, max_bits: int = MAX_BITS, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row: its SimHash and the smallest id that links lead to.

    A fingerprint bit is set where over half of the 64-bit hashes of the text's
    ``width``-word shingles (repeats included) have it; rows link when their
    fingerprints differ in ``max_bits`` bits or fewer.  Equal fingerprints are
    one from the start.  Candidates come from an inverted index of positional
    bytes; a pair goes on if it shares as many bytes at equal positions as
    ``max_bits`` differing bits leave equal at least, and its bits are then
    counted.  No list and no pair is cut.

    Texts without words (NULL, empty) have fingerprint zero and link like any
    other.  Rows without an id link too; ``component_id`` is the smallest id
    there is, NULL if the class has none.  Repeated rows and ids give a row
    each; other columns are left out; an empty table gives no rows.
    """
    if not 0 < shared < POSITIONS or max_bits + shared > POSITIONS:
        raise ValueError("prints are not sure to share so many bytes, or the bytes leave a key no room for their positions")
    rows = written(fingerprints(docs, width=width).withColumn("_run", F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).cast("int")), "fingerprints")
    runs = rows.groupBy("print", "_run").agg(F.min("doc_id").alias("least"))
    prints = written(runs.groupBy("print").agg(F.min("least").alias("least")), "distinct-prints")
    labels = print_labels(prints.select("print"), max_bits=max_bits, shared=shared, block=block)
    if labels is None:
        named = prints.select("print", F.col("least").alias("component_id"))
    else:
        of = prints.join(labels, prints["print"] == labels["node"], "left").select("print", "least", F.coalesce("label", "print").alias("label"))
        named = of.join(of.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("print", "component_id")
    # a class's name goes to the runs of a fingerprint, and from a run to its rows, so that equal texts are never joined in one task
    to_runs = runs.select("print", "_run").join(named, "print")
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(to_runs, ["print", "_run"]).select("doc_id", shown.alias("fingerprint"), "component_id")
