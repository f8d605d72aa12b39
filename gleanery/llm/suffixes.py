"""Removal of repeated passages by deep-shallow suffix sorting.

A passage is ``LENGTH`` bytes; every byte of a passage that starts in two
places goes.  Sorting all suffixes would ship each byte hundreds of times, so
suffixes are taken at anchors only: among the K-byte strings inside a passage
the one with the least hash, the leftmost of equals.  Equal passages choose
the same anchor at the same offset, so a passage can only be equal to one that
has an equal string at its anchor, and it is known by its anchor and by how far
before the anchor it starts.

1. Each text is cut into runs of passages with one anchor.  A run's *context*
   is the bytes its passages cover.  Equal contexts are one from here on.
2. Anchors with two or more different contexts are grouped, and the contexts'
   suffixes from the anchor on, and their prefixes before it, read backwards,
   are sorted: multikey quicksort over words to a shallow depth, then a blind
   trie for each group that is still equal there.  Equal parts of contexts are
   one before that, and a group of over HELD different ones is not sorted: its
   passages are counted.
3. Neighbours' common prefixes tell which passages are equal: those with equal
   bytes before the anchor and equal bytes from it on, for each offset.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import kept_in_worker, ship, worker_for, written
from gleanery.llm.minmax import mix
from gleanery.llm.words import slices

LENGTH = 200
#: Bytes of the string that makes an anchor.
K = 32
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 64
#: Contexts of an anchor beyond which they are grouped by what UNIT neighbouring passages share.
MANY, UNIT = 2000, 16
#: Passages of a text that are looked at together, and rows of a sort.
STRETCH, SORTED = 1 << 20, 16_384
#: Different contexts of a group beyond which its passages are counted, not sorted.
HELD = 16_384
#: What makes two contexts of a group equal.
SAME = ["g", "d1", "d2", "lo", "hi"]

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo 2^64, ``n`` at least."""

    def make():
        out = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, U)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            out.append(tuple(pair))
        return out

    size = max(1 << 21, 1 << n.bit_length())
    with np.errstate(over="ignore"):
        return kept_in_worker(f"powers {size}", make)


def anchored_runs(data: list[bytes], length: int = LENGTH, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per stretch of a text: its index and arrays ``h, c, x, lo, hi``.

    A run is the passages that start at ``x - hi`` to ``x - lo``; ``h`` is the
    hash of its anchor at ``x``, ``c`` of its context and of ``lo, hi``.
    """
    w = length - k + 1
    group: list[tuple[int, int, bytes]] = []
    room = 0

    def cut() -> Iterator:
        buffer = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        n = len(buffer)
        (p1, i1), (p2, i2) = _powers(n + 1)
        sums = []
        for p in (p1, p2):
            s = np.zeros(n + 1, U)
            np.cumsum((buffer.astype(U) + U(1)) * p[:n], dtype=U, out=s[1:])
            sums.append(s)
        m = n - k + 1
        h = mix((sums[0][k:] - sums[0][:m]) * i1[:m])
        # hash in the upper half, place in the lower: the least is the leftmost least
        key = h & U(0xFFFFFFFF00000000) | np.arange(m, dtype=U)
        blocks = np.concatenate([key, np.full(-m % w, ~U(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        starts = m - w + 1
        anchor = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & U(0xFFFFFFFF)).astype(np.int64)
        at = 0
        for row, offset, t in group:
            a = anchor[at : at + len(t) - length + 1]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            last = np.concatenate([first[1:], [len(a)]]) - 1
            x = a[first]
            lo, hi = x - (at + last), x - (at + first)
            s, e = at + first, at + last + length
            c = mix((sums[1][e] - sums[1][s]) * i2[s] + lo.astype(U) * U(0x2545F4914F6CDD1D) + hi.astype(U) * U(0xDA942042E4DD58B5))
            yield row, h[x].view(np.int64), c.view(np.int64), x - at + offset, lo, hi
            at += len(t)

    with np.errstate(over="ignore"):
        for row, t in enumerate(data):
            for offset in range(0, max(0, len(t) - length + 1), STRETCH):
                piece = t[offset : offset + STRETCH + length - 1]
                if group and room + len(piece) > STRETCH:
                    yield from cut()
                    group, room = [], 0
                group.append((row, offset, piece))
                room += len(piece)
        if group:
            yield from cut()


def _common(a: int, b: int, n: int) -> int:
    return n - ((a ^ b).bit_length() + 7) // 8


class BlindTrie:
    """Orders strings of one length; a node knows its depth and a byte per branch, never the bytes between."""

    def __init__(self, n: int):
        self.n = n
        self.root: list | None = None  # leaf: [None, members, string, number]; node: [depth, branches]

    def add(self, member: int, s: bytes) -> None:
        number = int.from_bytes(s, "big")
        leaf = [None, [member], s, number]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while node[0] is not None:  # blindly down to some leaf, which shares the most with s
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[3] == number:
            node[1].append(member)
            return
        depth = _common(node[3], number, self.n)
        other = node[2][depth]
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return
        fork = [depth, {other: node, s[depth]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]]] = fork

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (bytes of one length) within groups, and common prefixes with the row before.

    The first row of a group has -1.  Multikey quicksort takes a word of eight
    bytes as a character and goes on only where rows are equal so far.
    """
    count, n = strings.shape
    shallow = min(shallow, n) // 8 * 8
    words = np.ascontiguousarray(strings[:, :shallow]).view(">u8").astype(U) if shallow else np.zeros((count, 0), U)
    order = np.argsort(groups, kind="stable")
    label = groups[order]
    fresh = np.concatenate([[True], label[1:] != label[:-1]])
    for depth in range(words.shape[1] + 1):
        group = np.cumsum(fresh) - 1
        busy = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(busy) or depth == words.shape[1]:
            break
        word = words[order[busy], depth]
        by = np.lexsort((word, group[busy]))
        order[busy] = order[busy][by]
        word, inside = word[by], group[busy]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (inside[1:] != inside[:-1])])
        fresh[busy] = new
    if len(busy):
        edges = np.flatnonzero(np.concatenate([[True], group[busy][1:] != group[busy][:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[busy[a:b]]
            trie = BlindTrie(n)
            for r in rows.tolist():
                trie.add(r, strings[r].tobytes())
            order[busy[a:b]] = trie.ordered()
    common = np.full(count, -1, np.int64)
    for a in range(1, count, 65_536):
        b = min(count, a + 65_536)
        differ = strings[order[a:b]] != strings[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
    label = groups[order]
    common[np.concatenate([[True], label[1:] != label[:-1]])] = -1
    return order, common


def repeated_offsets(groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which passages occur twice: a row per context, a column per offset ``lo.min()`` to ``hi.max()``."""
    count, low, high = len(contexts), int(lo.min()), int(hi.max())
    right = np.zeros((count, length - low), np.uint8)
    left = np.zeros((count, max(1, high)), np.uint8)
    for r, (a, b, t) in enumerate(zip(lo.tolist(), hi.tolist(), contexts, strict=True)):
        row = np.frombuffer(t, np.uint8)
        right[r, : length - a] = row[b:]
        left[r, :b] = row[:b][::-1]
    places = np.arange(count)
    sides = []
    for strings in (left, right):
        order, common = deep_shallow(strings, groups)
        rank = np.empty(count, np.int64)
        rank[order] = places
        sides.append((rank, common))
    (left_rank, left_common), (right_rank, right_common) = sides
    out = np.zeros((count, high - low + 1), bool)
    for i in range(low, high + 1):
        here = np.flatnonzero((lo <= i) & (i <= hi))
        if len(here) < 2:
            continue
        # rows equal in the i bytes before the anchor, and in the rest from it on, have equal numbers
        before = np.maximum.accumulate(np.where(left_common < i, places, 0))[left_rank[here]]
        beyond = np.maximum.accumulate(np.where(right_common < length - i, places, 0))[right_rank[here]]
        both = before * count + beyond
        by = np.argsort(both, kind="stable")
        equal = both[by][1:] == both[by][:-1]
        twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        out[here[by[twice]], i - low] = True
    return out


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """``k1, k2, h, c, p`` per row that has a passage: arrays of anchored runs, ``p`` holding x, lo and hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("suffixes")
        for batch in batches:
            for part in slices(batch, "text"):
                rows, sizes, columns = [], [], ([], [], [])
                for row, h, c, x, lo, hi in anchored_runs(part.column("text").cast(pa.binary()).to_pylist(), length):
                    rows.append(row)
                    sizes.append(len(h))
                    for out, values in zip(columns, (h, c, x << 16 | lo << 8 | hi), strict=True):
                        out.append(values)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else [], pa.int64())) for v in columns]
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("k1").take(at), part.column("k2").take(at), *lists], ["k1", "k2", "h", "c", "p"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, h array<long>, c array<long>, p array<long>")


def _collapsed(runs: DataFrame) -> DataFrame:
    """``h, c, n, k2, p``: equal contexts of a batch as one row with a count and one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, p = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("h", "c", "p"))
            sizes = np.diff(batch.column("h").offsets.to_numpy())
            k2 = np.repeat(batch.column("k2").to_numpy(), sizes)
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([new, [len(h)]]))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (h[new], c[new], n, k2[order][new], p[order][new])], ["h", "c", "n", "k2", "p"])

    return runs.select("h", "c", "k2", "p").mapInArrow(run, "h long, c long, n long, k2 long, p long")


def _stored(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle, the columns before them as they are."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                packed = pa.array([pack(t) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [packed], [*names, "z"])

    schema = T.StructType([docs.schema[c] for c in names]).add("z", "binary")
    return docs.select(*names, "text").mapInArrow(run, schema)


def _contexts(rows: DataFrame, length: int, unit: int) -> DataFrame:
    """``g, d1, d2, k1, k2, x, lo, hi, t`` of the runs listed per text in ``at`` (``h, p, many``).

    A run of an anchor with many contexts comes in units of offsets; a unit's
    group is what all passages of the full unit share.  ``d1, d2`` are the
    digest of ``t``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = ["g", "d1", "d2", "k1", "k2", "x", "lo", "hi", "t"]
        kinds = [pa.int64()] * 8 + [pa.binary()]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names)

        def row(g: int, *place: int, t: bytes) -> tuple:
            return g, *struct.unpack("<qq", hashlib.blake2b(t, digest_size=16).digest()), *place, t

        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text = unpack(batch.column("z")[i].as_py())
                k1, k2 = batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py()
                for run_at in batch.column("at")[i].as_py():
                    x, lo, hi = run_at["p"] >> 16, run_at["p"] >> 8 & 255, run_at["p"] & 255
                    if x - lo + length > len(text) or x < hi:
                        continue  # another text with the same k2
                    if not run_at["many"]:
                        out.append(row(run_at["h"], k1, k2, x, lo, hi, t=text[x - hi : x - lo + length]))
                        continue
                    for u in range(lo // unit, hi // unit + 1):
                        a, b = u * unit, u * unit + unit - 1
                        shared = hashlib.blake2b(text[x - a : x - b + length], digest_size=8, key=u.to_bytes(2, "big")).digest()
                        a, b = max(a, lo), min(b, hi)
                        out.append(row(int.from_bytes(shared, "big", signed=True) ^ run_at["h"], k1, k2, x, a, b, t=text[x - b : x - a + length]))
                if len(out) >= 8192:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    return rows.mapInArrow(run, "g long, d1 long, d2 long, k1 long, k2 long, x long, lo long, hi long, t binary")


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """``k1, k2, start, beyond`` of repeated bytes, from contexts grouped by ``g``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def spans(rows: pa.RecordBatch) -> pa.RecordBatch:
            g, k1, k2, x, lo, hi = (rows.column(c).to_numpy() for c in ("g", "k1", "k2", "x", "lo", "hi"))
            start = beyond = row = np.zeros(0, np.int64)
            new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
            size = np.bincount(np.cumsum(new) - 1) if len(g) else new
            keep = np.flatnonzero(size[np.cumsum(new) - 1] > 1) if len(g) else row
            if len(keep):
                texts_ = rows.column("t").take(pa.array(keep)).to_pylist()
                flags = repeated_offsets(g[keep], lo[keep], hi[keep], texts_, length)
                edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                row, first = np.nonzero(edge == 1)
                last = np.nonzero(edge == -1)[1] - 1
                low = int(lo[keep].min())
                row = keep[row]
                start, beyond = x[row] - (last + low), x[row] - (first + low) + length
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (k1[row], k2[row], start, beyond)], ["k1", "k2", "start", "beyond"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SORTED:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = rows.column("g").to_numpy()
            whole = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if whole:
                yield spans(rows.slice(0, whole))
            held = [rows.slice(whole)]
        if held and sum(b.num_rows for b in held):
            yield spans(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(run, "k1 long, k2 long, start long, beyond long")


def _counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """What :func:`_sorted_spans` gives, from equal digests of passages; a group of any size is spread over tasks."""
    passage = F.substring("t", (F.col("hi") - F.col("i") + 1).cast("int"), F.lit(length))
    each = contexts.withColumn("i", F.explode(F.sequence("lo", "hi"))).select("g", "i", F.md5(passage).alias("m"), "k1", "k2", "x")
    twice = each.groupBy("g", "i", "m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "i", "m")
    start = F.col("x") - F.col("i")
    return each.join(twice, ["g", "i", "m"], "left_semi").select("k1", "k2", start.alias("start"), (start + length).alias("beyond"))


def _repeated_spans(contexts: DataFrame, length: int) -> DataFrame:
    """``k1, k2, start, beyond`` of the bytes that are repeated within groups of ``contexts``."""
    contexts = written(contexts, "contexts")
    alike = contexts.groupBy(*SAME).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct("k1", "k2", "x", "t")).alias("r"))
    once = written(alike.select(*SAME, "n", "r.*"), "different")
    again = contexts.join(once.filter("n > 1").select(*SAME), SAME, "left_semi")
    whole = again.select("k1", "k2", (F.col("x") - F.col("hi")).alias("start"), (F.col("x") - F.col("lo") + length).alias("beyond"))
    # one number for more than HELD rows, so small enough to broadcast
    large = F.broadcast(once.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HELD).select("g"))
    few, many = once.join(large, "g", "left_anti"), once.join(large, "g", "left_semi")
    return whole.unionByName(_sorted_spans(few.select("g", "k1", "k2", "x", "lo", "hi", "t"), length)).unionByName(_counted_spans(many, length))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(rows: DataFrame, length: int, many: int, unit: int) -> DataFrame:
    """:func:`without_repeats` of ``rows`` with ``doc_id, k1, k2, text``; columns before ``k1`` are carried along."""
    if not K <= length <= 255:
        raise ValueError(f"length must be {K} to 255")
    ship()
    runs = written(_runs(rows, length), "runs")
    # all rows of an anchor meet, equal contexts of a batch as one; what follows needs no further exchange
    met = _collapsed(runs).repartition("h").groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("k2").alias("k2"), F.min_by("p", "k2").alias("p"))
    anchors = met.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most")).filter("contexts > 1 OR most > 1")
    found = written(met.join(anchors, "h").filter("n > 1 OR contexts > 1"), "anchors")
    each = runs.select("k1", "k2", F.explode(F.arrays_zip("h", "c", "p")).alias("r")).select("k1", "k2", "r.h", "r.c", "r.p")
    twice = each.join(found.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    x, lo, hi = F.shiftright("p", 16), F.shiftright("p", 8).bitwiseAND(255), F.col("p").bitwiseAND(255)
    whole = twice.select("k1", "k2", (x - hi).alias("start"), (x - lo + length).alias("beyond"))
    at = F.collect_list(F.struct("h", "p", (F.col("contexts") > many).alias("many"))).alias("at")
    asked = found.filter("contexts > 1").groupBy(F.col("k2").alias("_k")).agg(at)
    # one exchange of the texts serves the contexts and the removal
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = _stored(rows).repartition(parts, "k2")
    contexts = _contexts(stored.join(asked, stored["k2"] == asked["_k"]).select(*stored.columns, "at"), length, unit)
    spans = whole.unionByName(_repeated_spans(contexts, length))
    spans = spans.groupBy(F.col("k2").alias("_k")).agg(F.collect_list(F.struct("k1", "start", "beyond")).alias("spans"))
    both = stored.join(spans, stored["k2"] == spans["_k"], "left").select(*stored.columns, "spans")
    carried = rows.columns[: rows.columns.index("k1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, k1 = unpack(batch.column("z")[i].as_py()), batch.column("k1")[i].as_py()
                gone = merged([(s["start"], s["beyond"]) for s in batch.column("spans")[i].as_py() or () if s["k1"] == k1])
                left = [text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True)]
                kept = b"".join(left)
                # each piece by itself, so that halves of two cut characters do not become a third
                shown = "".join([p.decode("utf-8", "ignore") for p in left])
                out.append((len(text), len(text) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest(), shown))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], made.names)

    made = T.StructType([rows.schema[c] for c in carried])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary"), ("kept_sha256", "string"), ("text", "string")):
        made = made.add(name, kind)
    return both.mapInArrow(run, made)


def _keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    k1, k2 = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)
    return docs.select(*carried, k1.alias("k1"), k2.alias("k2"), text.alias("text"))


def without_repeats(docs: DataFrame, *, length: int = LENGTH, many: int = MANY, unit: int = UNIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256``: what is left of every row's text.

    A byte goes if a string of ``length`` bytes that covers it also starts
    elsewhere, in this or another row's text (strings overlap, never cross
    rows, and are judged on the input); ``kept`` is the remaining bytes and may
    start or end inside a character.  NULL and shorter texts lose nothing, nor
    do texts of an empty table.  Rows are texts of their own whatever their
    id, so repeated rows lose all that fits a passage, and a NULL id is an id.
    Other columns are left out.
    """
    return _removed(_keyed(docs, F.col("doc_id")), length, many, unit).drop("text")


def strip_repeats(docs: DataFrame, *, length: int = LENGTH, many: int = MANY, unit: int = UNIT) -> DataFrame:
    """``docs``, all columns kept, with what :func:`without_repeats` leaves of ``text``.

    The first and last bytes of a character that a passage cuts go with it.  A
    NULL text stays NULL; repeated rows and rows without an id stay, each
    without what repeats; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    out = _removed(_keyed(docs, row.alias("row"), F.col("text").isNull().alias("missing")), length, many, unit)
    return out.select(*(F.when(~F.col("missing"), F.col("text")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
