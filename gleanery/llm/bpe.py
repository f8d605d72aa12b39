"""Byte-level BPE, encoded by a sentencepiece model made from the vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.common import kept_in_worker, ship, texts, worker_for
from gleanery.llm.token_counts import byte_letters
from gleanery.llm.words import Remembered, slices

# Fixed values of the model file: numbers of its fields, and of the kinds of pieces and models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_file(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks.

    A piece is the token with a letter for each byte, its score the negative
    rank, so the best-scored merge is the lowest-ranked one; nothing is
    normalised.  Ids between ranks, if any, and one at the end are unknown
    pieces that no byte string yields.
    """
    letters = byte_letters()
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks bytes {missing[:5]}")
    by_rank = {r: t for t, r in ranks.items()}
    size = max(by_rank) + 2
    out = []
    for rank in range(size):
        token = by_rank.get(rank)
        name = "".join(letters[b] for b in token) if token is not None else f"{rank}"
        kind = NORMAL if token is not None else UNKNOWN if rank == size - 1 else 5
        piece = _bytes(PIECE, name.encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", -float(rank)) + _number(KIND, kind)
        out.append(_bytes(PIECES, piece))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, size) + _number(UNK_ID, size - 1) + _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1)
    plain = _bytes(NAME, b"identity") + _number(DUMMY_PREFIX, 0) + _number(EXTRA_SPACES, 0) + _number(ESCAPE_SPACES, 0)
    return b"".join(out) + _bytes(TRAINER, trainer) + _bytes(NORMALIZER, plain)


class Codec:
    """Encodes pre-tokens with the model, decodes ids by the inverse of the vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_file(ranks))
        self.split = regex.compile(pattern).findall
        self.letters = {b: ord(c) for b, c in byte_letters().items()}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known = Remembered()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """A mapping with the ids, as little-endian unsigned 32-bit, of all given pre-tokens."""
        self.known.make_room()
        missing = list(pieces.difference(self.known))
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            mapped = [p.encode().decode("latin-1").translate(self.letters) for p in part]
            for p, ids in zip(part, self.model.encode(mapped, num_threads=1), strict=True):
                self.known.add(p, struct.pack(f"<{len(ids)}I", *ids))
        return self.known

    def encode(self, all_texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in all_texts]
        table = self.learn(set().union(*split))
        return [b"".join(map(table.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str, pattern: str, *, digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row, or with ``digests`` the SHA-256 of both instead.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes
    they stand for.  NULL text is empty: no ids.  Text runs that the pattern
    skips have no ids, as with the pattern's own library.  Rows are
    independent, so repeated rows and ids give a row each; other columns are
    left out.
    """
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("codec")
        codec = kept_in_worker(f"codec {path} {pattern}", lambda: Codec(path, pattern))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = codec.encode(part.column("text").to_pylist())
                plain = [codec.decode(x) for x in ids]
                counts = pa.array([len(x) >> 2 for x in ids], pa.int64())
                if digests:
                    both = [pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (ids, plain)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, *both], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    both = [pa.array(side, pa.binary()) for side in (ids, plain)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, *both], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, {made}")


def decoded(encoded_rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` from rows with ``doc_id, ids`` (NULL ids: empty text)."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("codec")
        codec = kept_in_worker(f"codec {path} {pattern}", lambda: Codec(path, pattern))
        for batch in batches:
            out = [codec.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = encoded_rows.schema["doc_id"].dataType.simpleString()
    return encoded_rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
