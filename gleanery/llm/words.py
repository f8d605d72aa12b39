"""Token ids of white-space separated words, looked up once per worker.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins what
stands on two sides of it, so a text's ids are its words' ids in order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
import pyarrow.compute as pc

from gleanery.llm.common import kept_in_worker

#: Words that a worker remembers, and their bytes; beyond it starts anew, which costs time only.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64 << 20
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20


def tokenizer(path: str):
    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return kept_in_worker(f"tokenizer {path}", load)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``most`` bytes in ``column``, one row at least."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < len(sizes):
        yield batch.slice(start)


class Remembered(dict):
    """A worker's table of words, emptied before it grows beyond its bounds."""

    size = 0

    def make_room(self) -> None:
        if len(self) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.clear()
            self.size = 0

    def add(self, word, ids: bytes) -> None:
        self[word] = ids
        self.size += len(word) + len(ids)


#: ASCII punctuation that forms one pre-token when it ends a word; apostrophes and what special strings are made of are left out.
_TAIL = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'


def _is_one_token_run(s: str) -> bool:
    """Letters only, and so after normalisation: the pattern leaves such a word whole."""
    return s.isalpha() and (s.isascii() or (s.lower().isalpha() and is_normalized("NFC", s)))


class Encoder:
    """Ids of single words.  Words of letters are encoded many at a time, apart by spaces, and told apart by the tokens that end a word."""

    def __init__(self, path: str):
        import numpy as np

        self.tokenizer = tokenizer(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _alone(self, part: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _together(self, part: list[str]) -> list[bytes]:
        import numpy as np

        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(part):
            return self._alone(part)
        data, edges = ids.tobytes(), [0, *(last * 4).tolist()]
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, words: list[bytes], known: dict[bytes, bytes]) -> None:
        """Put the ids of ``words`` into ``known``.  Letters with punctuation behind are the ids of either part."""
        whole: dict[bytes, str] = {}
        other: dict[bytes, str] = {}
        tailed: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            s = w.decode("utf-8", "replace")
            if _is_one_token_run(s):
                whole[w] = s
                continue
            core = s.rstrip(_TAIL)
            if core and core != s and _is_one_token_run(core):
                a, b = core.encode(), s[len(core) :].encode()
                tailed.append((w, a, b))
                if a not in known:
                    whole[a] = core
                if b not in known:
                    other[b] = s[len(core) :]
            else:
                other[w] = s
        for some, how, step in ((whole, self._together, 256), (other, self._alone, 4096)):
            raw, shown = list(some), list(some.values())
            for i in range(0, len(raw), step):
                for w, ids in zip(raw[i : i + step], how(shown[i : i + step]), strict=True):
                    known.add(w, ids)
        for w, a, b in tailed:
            known.add(w, known[a] + known[b])


def _remembered(path: str) -> Remembered:
    known: Remembered = kept_in_worker(f"words {path}", Remembered)
    known.make_room()
    return known


def _learn(path: str, missing: set[bytes], known: Remembered) -> None:
    if missing:
        kept_in_worker(f"encoder {path}", lambda: Encoder(path)).encode(list(missing), known)


def word_table(path: str, split: list[list[bytes]]) -> dict[bytes, bytes]:
    """A mapping that has the ids (little-endian unsigned 32-bit) of all given words."""
    known = _remembered(path)
    missing: set[bytes] = set()
    for words in split:
        missing.update(words)
    missing.difference_update(known)
    _learn(path, missing, known)
    return known


def word_ids(path: str, split: list[list[bytes]]) -> list[list[bytes]]:
    """The ids of the words of each text; a word is looked up once."""
    known = _remembered(path)
    found = [list(map(known.get, words)) for words in split]
    missing: set[bytes] = set()
    for words, ids in zip(split, found, strict=True):
        if None in ids:
            missing.update([w for w, x in zip(words, ids, strict=True) if x is None])
    _learn(path, missing, known)
    return [[known[w] if x is None else x for w, x in zip(words, ids, strict=True)] if None in ids else ids for words, ids in zip(split, found, strict=True)]
