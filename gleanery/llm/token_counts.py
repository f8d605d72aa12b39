"""Token counts of every prefix of a text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import kept_in_worker, ship, texts, worker_for
from gleanery.llm.words import slices, tokenizer, word_table

WORD_END = "</w>"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordPrefixes:
    """Counts for every prefix of one pre-token, by dynamic programming.

    A token sequence is what the merges give exactly if each two neighbours
    are: merged afresh, the two come out again.  So the last token of a prefix
    of length i is the one token t ending there that may follow the last token
    of the prefix without t, and its count is that prefix's plus one.  A prefix
    that ends the word ends in a token with the word-end mark; the table of
    unmarked prefixes serves both.
    """

    def __init__(self, model: dict):
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.follows: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(WORD_END):
            bare = token.removesuffix(WORD_END)
            return [*bare[:-1], bare[-1] + WORD_END]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def may_follow(self, last: str, token: str) -> bool:
        key = (last, token)
        if key not in self.follows:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            want = [last, token] if last else [token]
            self.follows[key] = self.merged([*(self.symbols(last) if last else []), *self.symbols(token)]) == want
        return self.follows[key]

    def counts(self, word: bytes) -> list[int]:
        """``counts(w)[i]``: tokens of the first i bytes of ``w`` taken as a whole word."""
        s = "".join(self.letters[b] for b in word)
        last, open_count, out = [""], [0], [0]
        for i in range(1, len(s) + 1):
            for mark in ("", WORD_END):
                for j in range(max(0, i - self.longest), i):
                    token = s[j:i] + mark
                    if token in self.vocab and last[j] is not None and self.may_follow(last[j], token):
                        if mark:
                            out.append(open_count[j] + 1)
                        else:
                            last.append(token)
                            open_count.append(open_count[j] + 1)
                        break
                else:
                    raise ValueError(f"no token ends at byte {i} of {word!r}")
        return out


class TextPrefixes:
    """Exact counts of prefixes that end inside a white-space separated word."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = WordPrefixes(spec["model"])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = tokenizer(path)
        self.known: dict[str, list[int]] = {}

    def _of_token(self, token: str) -> list[int]:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self.words.counts(token.encode())
        return self.known[token]

    def count(self, word: str) -> int:
        """Tokens of ``word``, which holds no ASCII white space."""
        if any(s in word for s in self.special):
            return len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        plain = self.tokenizer.normalizer.normalize_str(word)
        return sum(self._of_token(t)[-1] for t in self.pattern.findall(plain))

    def within(self, word: str, budget: int) -> tuple[int, int]:
        """Code points of the longest proper prefix of ``word`` with at most ``budget`` tokens, and its count."""
        # a code point that is no white space costs a byte at least, so no longer prefix can do
        room, most = budget * max(self.words.longest, *map(len, self.special)), 0
        for c in word[:-1]:
            room -= not c.isspace()
            if room < 0:
                break
            most += 1
        full = self.pattern.findall(self.tokenizer.normalizer.normalize_str(word[:most]))
        before = [0]
        for t in full:
            before.append(before[-1] + self._of_token(t)[-1])
        special = any(s in word[:most] for s in self.special)
        for n in range(most, 0, -1):
            here = self.pattern.findall(self.tokenizer.normalizer.normalize_str(word[:n]))
            k = len(here)
            if not special and k and here[:-1] == full[: k - 1] and k <= len(full) and full[k - 1].startswith(here[-1]):
                c = before[k - 1] + self._of_token(full[k - 1])[len(here[-1].encode())]
            else:
                c = self.count(word[:n])
            if c <= budget:
                return n, c
        return 0, 0


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, ends, counts``: the count at every word's end, one row per input row.

    ``ends[i]`` is the byte at which the i-th white-space separated word ends,
    ``counts[i]`` the tokens of the text up to there: the count at the word
    before plus the word's own.  Prefixes that end inside a word follow from the
    word's own table (:class:`TextPrefixes`), so no question about a prefix
    encodes the text again.  NULL text is empty and has no entries; rows are
    independent, so repeated rows and ids give a row each; other columns are
    left out; an empty table gives no rows.  A long text is worked on by itself
    and whole.
    """
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        worker_for("words")
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        for batch in batches:
            for part in slices(batch, "text"):
                data = part.column("text").cast(pa.binary()).to_pylist()
                split = [t.split() for t in data]
                table = word_table(path, split)
                ends, counts, at = [], [], [0]
                for raw, words in zip(data, split, strict=True):
                    sizes = np.fromiter((len(table[w]) for w in words), np.int32, len(words))
                    counts.append(np.cumsum(sizes >> 2, dtype=np.int32))
                    blank = np.append(space[np.frombuffer(raw, np.uint8)], True)
                    ends.append((np.flatnonzero(~blank[:-1] & blank[1:]) + 1).astype(np.int32))
                    at.append(at[-1] + len(words))
                offsets = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (ends, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in data], pa.int64()), *lists], ["doc_id", "n_bytes", "ends", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, ends array<int>, counts array<int>")


def n_tokens() -> Column:
    """Tokens of the whole text, from a row of :func:`prefix_counts`."""
    return F.coalesce(F.get("counts", F.size("counts") - 1), F.lit(0)).cast("long")


def words_within(budget: int) -> Column:
    """Whole words that fit a budget of tokens, from a row of :func:`prefix_counts`."""
    return F.size(F.filter("counts", lambda c: c <= budget))


def truncate(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``doc_id, text, n_tokens``: the longest prefix, in code points, of at most ``budget`` tokens.

    Whole words come from the prefix table of the row; in the word that does
    not fit, its own table tells how much of it does.  White space after the
    last kept word is cut.  NULL text is empty.
    """
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("words")
        for batch in batches:
            inner = kept_in_worker(f"prefixes {path}", lambda: TextPrefixes(path))
            out, left = [], []
            for part in slices(batch, "text"):
                data = part.column("text").cast(pa.binary()).to_pylist()
                split = [t.split() for t in data]
                table = word_table(path, split)
                for raw, words in zip(data, split, strict=True):
                    used = end = 0
                    for w in words:
                        start, n = raw.index(w, end), len(table[w]) >> 2
                        if used + n > budget:
                            points, extra = inner.within(w.decode("utf-8", "replace"), budget - used)
                            if points:
                                used, end = used + extra, start + len(w.decode("utf-8", "replace")[:points].encode())
                            break
                        used, end = used + n, start + len(w)
                    out.append(raw[:end].decode("utf-8", "replace"))
                    left.append(used)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(left, pa.int64())], ["doc_id", "text", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, text string, n_tokens long")
