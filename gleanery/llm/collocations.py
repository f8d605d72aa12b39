"""Phrase collocations by SON partitioning: shards mined at lowered support, candidates counted exactly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import ship, worker_for, written
from gleanery.llm.minmax import coefficients, mix
from gleanery.llm.words import slices

#: Shards that the table is dealt into; each is mined at its share of the support.
SHARDS = 3
#: Bits of the filter that tells tasks what was frequent in a shard; its size does not depend on the data.
FILTER_BITS = 1 << 26
PROBES = 2
#: Bytes of text that are counted at a time.
SLICE = 2 << 20

SUPPORT, MAX_WORDS, TOP = 10, 3, 2000
#: Parts of a language that are ranked by themselves.
PARTS = 8
#: A phrase goes if a longer one has this share (per cent) of its occurrences.
INSIDE_PERCENT = 50
#: Fixed values of the contract: what ends a piece, and the name of a missing language.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"

U = np.uint64
_TO_STOP = bytes(ord(".") if b in PIECE_END else b for b in range(256))


class Pieces:
    """The words of some texts of one language, as numbers within this slice; 0 stands between pieces."""

    def __init__(self, data: list[bytes]):
        joined = b".".join([t.lower().translate(_TO_STOP) for t in data]).replace(b".", b" . ")
        self.tokens = joined.split()
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.known[b"."]
        self.ids = np.fromiter(map(self.known.__getitem__, self.tokens), np.int64, len(self.tokens))
        self.is_word = self.ids != 0
        self.n_words = int(self.is_word.sum())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every token."""
        import xxhash

        return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=7), self.known), U, len(self.known))[self.ids]

    def whole(self, size: int) -> np.ndarray:
        """Per token: do ``size`` words of one piece start there?"""
        n = max(0, len(self.ids) - size + 1)
        out = np.ones(n, bool)
        for j in range(size):
            out &= self.is_word[j : j + n]
        return out

    def numbered(self, size: int, at: np.ndarray) -> np.ndarray:
        """For the tokens ``at``, numbers that only equal phrases of ``size`` words share within this slice."""
        out, bound = self.ids[at], len(self.known)
        for j in range(1, size):
            if bound * len(self.known) >= 1 << 62:
                out, bound = np.unique(out, return_inverse=True)[1], len(out)
            out, bound = out * len(self.known) + self.ids[at + j], bound * len(self.known)
        return out


def phrase_hashes(tokens: np.ndarray, size: int, lang: str) -> np.ndarray:
    """A hash of the phrase of ``size`` words at every token, told apart by size and language."""
    import xxhash

    n = max(0, len(tokens) - size + 1)
    with np.errstate(over="ignore"):
        sums = np.full(n, U(xxhash.xxh64_intdigest(lang, seed=size)), U)
        for j, c in enumerate(coefficients(size, 6)):
            sums += tokens[j : j + n] * c
        return mix(sums)


class Filter:
    """Tells which hashes were seen: never denies one that was, and seldom admits another."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        bits = U(len(self.words) * 64 - 1)
        for k in range(PROBES):
            at = (hashes >> U(k * 26)) & bits
            out &= (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
        return out


def filter_words(candidates: DataFrame, bits: int) -> np.ndarray:
    """The filter's bits for the column ``key``: at most ``bits / 64`` numbers reach the driver, whatever the table's size."""
    at = F.array(*(F.expr(f"shiftrightunsigned(key, {26 * k}) & {bits - 1}L") for k in range(PROBES)))
    rows = candidates.select(F.explode(at).alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    got = rows.toArrow()
    words = np.zeros(bits // 64, U)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(U)
    return words


def _languages(part: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
        out.setdefault(lang, []).append(text)
    return out


def local_counts(docs: DataFrame, sizes: list[int], filtered=None, shards: int = SHARDS) -> DataFrame:
    """``key, shard, n``: occurrences of the phrases of ``sizes`` words, by hash, in slices of the table.

    A slice belongs to one shard, named by a hash of its first text.  With a
    filter (a broadcast of :func:`filter_words`) only phrases count whose two
    parts of one word less pass it.
    """
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_for("collocations")
        seen = Filter(filtered.value) if filtered is not None else None
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                shard = xxhash.xxh64_intdigest(part.column("text")[0].as_py() or "") % shards
                keys, found = [], []
                for lang, data in _languages(part).items():
                    pieces = Pieces(data)
                    tokens = pieces.hashes()
                    for size in sizes:
                        ok = pieces.whole(size)
                        if seen is not None and len(ok):
                            inner = seen(phrase_hashes(tokens, size - 1, lang))
                            ok &= inner[:-1] & inner[1:]
                        key, n = np.unique(phrase_hashes(tokens, size, lang)[ok], return_counts=True)
                        keys.append(key)
                        found.append(n)
                key, n = np.concatenate(keys).view(np.int64), np.concatenate(found).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(n), shard, np.int32)), pa.array(n)], ["key", "shard", "n"])

    return docs.mapInArrow(run, "key long, shard int, n long")


def frequent_in_a_shard(counts: DataFrame, support: int, shards: int) -> DataFrame:
    """``key`` of what reaches a shard's share of the support in that shard.

    Shards are equal shares: a phrase below ``support / shards`` in every one is
    below the support in all, so none is missed.
    """
    of = [F.sum(F.when(F.col("shard") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(shards)]
    reached = F.lit(False)
    for i in range(shards):
        reached |= F.col(f"n{i}") >= ceil(support / shards)
    return written(counts.groupBy("key").agg(*of).filter(reached).select("key"), "locally-frequent")


def counted_phrases(docs: DataFrame, sizes: list[int], filtered) -> DataFrame:
    """``lang, size, phrase, n`` of all phrases that pass the filter, by their words; the empty phrase counts the words."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("collocations")
        seen = Filter(filtered.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for lang, data in _languages(part).items():
                    pieces = Pieces(data)
                    tokens = pieces.hashes()
                    size_of, phrases, found = [0], [b""], [pieces.n_words]
                    for size in sizes:
                        ok = pieces.whole(size)
                        ok &= seen(phrase_hashes(tokens, size, lang))
                        at = np.flatnonzero(ok)
                        _, first, n = np.unique(pieces.numbered(size, at), return_index=True, return_counts=True)
                        phrases += [b" ".join(pieces.tokens[p : p + size]) for p in at[first].tolist()]
                        found += n.tolist()
                        size_of += [size] * len(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array(size_of, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(found, pa.int64())], ["lang", "size", "phrase", "n"]
                    )

    return docs.mapInArrow(run, "lang string, size int, phrase string, n long")


def phrase_counts(docs: DataFrame, *, support: int = SUPPORT, max_words: int = MAX_WORDS, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, size, phrase, n``: exact counts of all phrases of up to ``max_words`` words found ``support`` times or more.

    The table is dealt into shards, each mined completely at its share of the
    support, level by level: a phrase is looked at where its two parts of one
    word less are frequent in some shard.  What is frequent in a shard is a
    candidate; a last pass counts all candidates over all texts by their words.
    Mining works on 64-bit hashes, where a collision can only add a candidate.
    Tasks know the candidates by a filter of ``filter_bits`` bits: false
    admissions are counted too and fall to the support.  Size 0 is the empty
    phrase, whose count is all words of the language.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    context = docs.sparkSession.sparkContext
    words = np.zeros(filter_bits // 64, U)
    sent = None
    for sizes in [[1, 2], *([k] for k in range(3, max_words + 1))]:
        found = frequent_in_a_shard(local_counts(rows, sizes, sent, shards), support, shards)
        words |= filter_words(found, filter_bits)
        if sent is not None:
            sent.unpersist()
        sent = context.broadcast(words.copy())
    counts = counted_phrases(rows, list(range(1, max_words + 1)), sent).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    counts = written(counts.filter(F.col("n") >= F.when(F.col("size") == 0, 0).otherwise(support)), "phrase-counts")
    sent.unpersist()
    return counts


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, top: int = TOP, inside_percent: int = INSIDE_PERCENT, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut,
    ``n`` the language's words; ``score`` is a million times a² / (l · r),
    rounded down, the least of all cuts (ties: the shorter first part).  A
    phrase goes if a longer one around it has ``inside_percent`` per cent of its
    occurrences or more.  Order: score and ``a`` falling, then the phrase by its
    bytes.

    NULL text is empty, a NULL language is ``und``.  Rows are texts of their
    own, so repeated rows count each; other columns, ids included, are left
    out; a table without words gives no rows.
    """
    counts = phrase_counts(docs, **options)
    words = F.split("phrase", " ")
    phrases = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    total = counts.filter("size = 0").select("lang", F.col("n").alias("n"))
    known = counts.filter("size > 0").select("lang", "phrase", "n")
    # the largest count of a longer phrase around each phrase
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _part(F.col("w"), i, k))))
    around = phrases.filter("size > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = phrases.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_longer") < inside_percent * F.col("a"), F.lit(True))).drop("_longer")
    cuts = left.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("_l"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("_r"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_l"), F.col("n").alias("l")), ["lang", "_l"]).join(known.select("lang", F.col("phrase").alias("_r"), F.col("n").alias("r")), ["lang", "_r"])
    d = {c: F.col(c).cast("decimal(14,0)") for c in "alr"}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (d["a"] * d["a"] * F.lit(1_000_000).cast("decimal(7,0)")).alias("_p"), (d["l"] * d["r"]).alias("_q")).withColumn("score", F.expr("_p div _q"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.score", "s.a", "s.l", "s.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each part first, so that a language's last task sees PARTS * top rows at most
    parts = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = parts.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
