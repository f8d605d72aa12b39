"""Near-duplicate groups by min-max hashing, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import only, ship, texts, worker_for, written
from gleanery.llm.graph import components
from gleanery.llm.words import slices

WIDTH, PERCENT = 3, 85
#: Permutations; each gives two values of the signature.
PERMUTATIONS = 48
#: Values in a band.  With 24 bands of 4, a pair at similarity 0.85 shares none with probability 2e-8.
BAND = 4
#: Members of a bucket that are compared in one task.
BLOCK = 192
#: Rounds in which each bucket is compared with one member, before the rest is compared in blocks.
PIVOTS = 1

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def coefficients(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same for a seed everywhere."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and the words before each text (one more entry than texts)."""
    buffer = np.frombuffer(b" ".join([t.lower() for t in data]) + b" ", np.uint8)
    blank = _SEPARATOR[buffer]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    before = np.searchsorted(start, begins)
    if not len(start):
        return np.zeros(0, U), before
    inside = np.flatnonzero(~blank)
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    size = ends - start
    place = inside - np.repeat(start, size)
    table = coefficients(int(size.max()), 1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((buffer[inside].astype(U) + U(1)) * table[place], np.concatenate([[0], np.cumsum(size)[:-1]]))
        return mix(sums + size.astype(U) * U(0xD6E8FEB86659FD93)), before


def shingle_sets(data: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    words, before = word_hashes(data)
    factor = coefficients(width, 2)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        sums = np.zeros(n, U)
        for k in range(width):
            sums += words[k : k + n] * factor[k]
        every = mix(sums)
        out = []
        for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if hi - lo >= width:
                out.append(np.unique(every[lo : hi - width + 1]))
            elif hi > lo:
                short = (words[lo:hi] * factor[: hi - lo]).sum(dtype=U) + U(0xA0761D6478BD642F * (hi - lo) & (1 << 64) - 1)
                out.append(mix(np.array([short], U)))
            else:
                out.append(np.zeros(0, U))
        return out


def signature(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """Minimum and maximum under each permutation, next to one another."""
    out = np.empty((permutations, 2), U)
    a, b = coefficients(permutations, 3), coefficients(permutations, 4)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 1 << 14):
            values = shingles[None, k : k + (1 << 14)] * a[:, None] + b[:, None]
            low, high = values.min(axis=1), values.max(axis=1)
            out[:, 0] = low if not k else np.minimum(out[:, 0], low)
            out[:, 1] = high if not k else np.maximum(out[:, 1], high)
    return out.reshape(-1)


def band_keys(signatures: np.ndarray, band: int) -> np.ndarray:
    """A number for each ``band`` neighbouring values of the signatures (one per row)."""
    n, width = signatures.shape
    factor = coefficients(band, 5)
    with np.errstate(over="ignore"):
        grouped = mix(signatures[:, : width // band * band]).reshape(n, width // band, band)
        return mix((grouped * factor).sum(axis=2, dtype=U))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, *, width: int = WIDTH, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands`` per row: set size, 128 bits that name the set, band keys."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("minmax")
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), width)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), 2 * permutations // band), U)
                if len(full):
                    keys[full] = band_keys(np.stack([signature(sets[i], permutations) for i in full]), band)
                with np.errstate(over="ignore"):
                    names = [np.array([mix(s * U(2 * k + 3) + U(k)).sum(dtype=U) for s in sets], U).view(np.int64) for k in (1, 2)]
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *map(pa.array, names), bands], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>")


def packed(rows: DataFrame) -> DataFrame:
    """``rep, z`` of ``rep, text``: texts compressed for the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([pack(t) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())], ["rep", "z"])

    return rows.select("rep", "text").mapInArrow(run, "rep long, z binary")


def unpacked(batch: pa.RecordBatch, column: str, width: int, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch, of about ``most`` bytes of text, with the shingle sets of a compressed column."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    start, size, held = 0, 0, []
    for i, z in enumerate(batch.column(column)):
        text = unpack(z.as_py())
        if held and size + len(text) > most:
            yield batch.slice(start, i - start), shingle_sets(held, width)
            start, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield batch.slice(start), shingle_sets(held, width)


def confirmed(pairs: DataFrame, sources: DataFrame, *, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose full sets are similar enough; ``sources`` is of :func:`packed`."""
    left = sources.select(F.col("rep").alias("a"), F.col("z").alias("_za"))
    right = sources.select(F.col("rep").alias("b"), F.col("z").alias("_zb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "_za", "_zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last_set = None, None
            a, b = [], []
            for part, sets in unpacked(batch, "_zb", width):
                ids = part.column("a").to_pylist()
                for i, (x, y) in enumerate(zip(ids, part.column("b").to_pylist(), strict=True)):
                    if x != first:
                        first, last_set = x, next(unpacked(part.select(["_za"]).slice(i, 1), "_za", width))[1][0]
                    if linked(last_set, sets[i], percent):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _linked_in_block(block: list[tuple[bool, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that join different groups within a block; entries are (seeks, rep, label, set).

    Each seeker is compared with every entry of another group so far; entries
    that do not seek are of one group and need no comparison with each other.
    """
    group = {label: label for _, _, label, _ in block}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    sizes = np.array([len(s) for *_, s in block])
    every = np.concatenate([s for *_, s in block])
    by = np.argsort(every, kind="stable")
    every, owner = every[by], np.repeat(np.arange(len(block)), sizes)[by]
    for i, (seeks, rep, label, own) in enumerate(block):
        if not seeks:
            continue
        if all(root(label) == root(x[2]) for x in block):
            break
        # which entries hold each shingle, and so how many each entry shares
        both = np.zeros(len(block), np.int64)
        for k in range(0, len(own), 2048):
            some = own[k : k + 2048]
            first, last = np.searchsorted(every, some, "left"), np.searchsorted(every, some, "right")
            found = last - first
            at = np.arange(found.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(found)[:-1]]), found)
            both += np.bincount(owner[at], minlength=len(block))
        for j in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
            if j != i and root(block[j][2]) != root(label):
                group[root(block[j][2])] = root(label)
                out.append((rep, block[j][1]))
    return out


def compared_in_blocks(members: DataFrame, sources: DataFrame, *, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between members of one bucket that have different labels, all pairs considered.

    ``members`` has ``bucket, rep, label``.  In a bucket, members of its most
    frequent label stay in blocks of their own; the others are sent to every
    block of the bucket, so two members of different labels meet in one.  A
    task holds one block: links found are at most one per label joined there.
    """
    per = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("_most"), F.sum("n").alias("_all"), F.max("n").alias("_main"))
    rows = members.join(most, "bucket").withColumn("seeks", F.col("label") != F.col("_most"))
    mains, seekers = F.ceil(F.col("_main") / block), F.ceil((F.col("_all") - F.col("_main")) / block)
    # blocks of the main label, and of the others: a seeker meets every block of either kind with its own block
    own = F.pmod(F.xxhash64("rep", "bucket"), F.when(F.col("seeks"), seekers).otherwise(mains))
    rows = rows.withColumn("_own", own)
    cells = F.when(
        F.col("seeks"),
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), mains - 1), lambda m: F.struct(F.col("_own").alias("x"), (-m - 1).alias("y"))),
            F.transform(F.sequence(F.lit(0).cast("long"), seekers - 1), lambda s: F.struct(F.least("_own", s).alias("x"), F.greatest("_own", s).alias("y"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(seekers, F.lit(1)) - 1), lambda s: F.struct(s.alias("x"), (-F.col("_own") - 1).alias("y"))))
    placed = rows.select("bucket", "rep", "label", "seeks", F.explode(cells).alias("_c")).select("bucket", "rep", "label", "seeks", F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"))
    full = placed.join(sources, "rep").repartition("bucket", "_x", "_y").sortWithinPartitions("bucket", "_x", "_y", F.col("seeks").desc(), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, entries = None, []

        def done() -> pa.RecordBatch:
            found = _linked_in_block(entries, percent) if len(entries) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for part, sets in unpacked(batch, "z", width):
                columns = [part.column(c).to_pylist() for c in ("bucket", "_x", "_y", "seeks", "rep", "label")]
                for i, (*cell, seeks, rep, label) in enumerate(zip(*columns, strict=True)):
                    if cell != here:
                        yield done()
                        here, entries = cell, []
                    entries.append((seeks, rep, label, sets[i]))
        yield done()

    return full.select("bucket", "_x", "_y", "seeks", "rep", "label", "z").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, permutations: int = PERMUTATIONS, band: int = BAND, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the group of near-duplicates of every row.

    Two rows are linked when their sets of ``width``-word shingles have a
    similarity of ``percent`` per cent or more; a group is what links connect,
    named by its smallest ``doc_id``.  Equal sets are one representative from
    the start.  Min-max signatures are banded into buckets; a bucket's members
    are compared with one pivot after another, which joins most of a group by
    as many pairs as it has members, and what is left in different groups of
    one bucket is then compared in blocks, so every pair of a bucket ends in
    one group or was compared on full sets.

    Texts without words (NULL, empty) have no shingles and are groups of their
    own, as are rows without an id (their ``component_id`` is NULL, and they are
    kept).  Rows that share an id are one node: they count as linked, and each
    is kept if its id names the group.  Other columns are left out; an empty
    table gives no rows.
    """
    ship()
    rows = written(signatures(docs, width=width, permutations=permutations, band=band), "signatures")
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("set_a", "set_b").agg(F.min("doc_id").cast("long").alias("rep"), F.first("bands").alias("bands")), "classes")
    each = classes.select("rep", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("bucket"), "rep")
    # buckets of one member list are one bucket; lists are told apart by their size and two sums of hashes
    lists = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.shiftright(F.xxhash64("rep", F.lit(1)), 20)).alias("y"))
    lists = lists.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    members = written(each.join(lists.select("bucket"), "bucket"), "members")
    wanted = members.select("rep").distinct()
    source = packed(texts(docs).filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("rep"), "text"))
    sources = written(source.join(wanted.hint("merge"), "rep", "left_semi"), "sources")
    labels = None

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("label", F.col("rep"))
        return members.join(labels, members["rep"] == labels["node"], "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))

    def mixed(*picked: Column) -> DataFrame:
        """Members of buckets with more than one label, with what ``picked`` says of the bucket."""
        rows = labelled()
        buckets = rows.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), *picked).filter("_lo <> _hi")
        return rows.join(buckets.drop("_lo", "_hi"), "bucket")

    def links(turn: int) -> DataFrame:
        if turn == pivots:
            return compared_in_blocks(written(mixed(), "open"), sources, width=width, percent=percent, block=block)
        key = [F.col("rep"), -F.col("rep")][turn] if turn < 2 else F.xxhash64("rep", "bucket", F.lit(turn))
        rows = mixed(F.min_by("rep", key).alias("_pivot"), F.min_by("label", key).alias("_of")).filter("label <> _of")
        pairs = rows.select(F.least("rep", "_pivot").alias("a"), F.greatest("rep", "_pivot").alias("b")).distinct()
        return confirmed(written(pairs, "pairs"), sources, width=width, percent=percent)

    for turn in range(pivots + 1):
        found = written(links(turn), "links")
        if not found.isEmpty():
            labels = components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    named = classes if labels is None else classes.join(labels, classes["rep"] == labels["node"], "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("rep"))
    named = named.select("set_a", "set_b", F.col("rep").alias("_c"))
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("_c")), F.col("doc_id"))
    out = rows.join(named, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that :func:`near_groups` does not keep, all columns kept."""
    kept = near_groups(docs, **options).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    return only(docs, kept, id=docs["doc_id"])
