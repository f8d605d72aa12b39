"""Token counts, byte-level BPE and packing against the tokenizers' own libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import bpe, catalog, packing, token_counts, words
from tests.llm.cases import awkward, empty, plain, table

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_bpe():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_counts(spark, word_bpe):
    got = token_counts.prefix_counts(table(spark), WORDS).collect()
    want = sorted(((i, len((t or "").encode()), len(ids(word_bpe, t))) for i, t, *_ in awkward()), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.counts[-1] if r.counts else 0) for r in got), key=repr) == want
    text = dict((i, t) for i, t, *_ in awkward())
    for r in got:
        if r.doc_id in (3, 13, 15):
            for end, n in zip(r.ends, r.counts, strict=True):
                assert len(ids(word_bpe, text[r.doc_id].encode()[:end].decode())) == n
    assert token_counts.prefix_counts(empty(spark), WORDS).count() == 0


def test_every_prefix_of_a_word(word_bpe):
    inner = token_counts.TextPrefixes(WORDS)
    for w in ["international", "éàünaïve", "it's", "don't~~", "x7x77,..", "l'été", "ﬁ²x́", "İstanbul", "<|endoftext|>a", "antidisestablishmentarianism"]:
        for n in range(1, len(w) + 1):
            assert inner.count(w[:n]) == len(ids(word_bpe, w[:n])), w[:n]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30))
def test_words_of_any_text(text):
    t = words.tokenizer(WORDS)
    split = text.encode().split()
    found = b"".join(words.word_table(WORDS, [split])[w] for w in split)
    assert found == np.array(ids(t, text), "<u4").tobytes()


def test_truncate(spark, word_bpe):
    for budget in (0, 1, 5, 40):
        got = token_counts.truncate(table(spark), WORDS, budget).collect()
        assert len(got) == len(awkward())
        for r in got:
            assert len(ids(word_bpe, r.text)) == r.n_tokens <= budget


def test_truncate_finds_the_longest(spark, word_bpe):
    made = ["a" + "\u00a0" * 3000 + "b", "x\u00a0\u2003y z", "don't stop", "word\u00a0<|endoftext|>\u00a0tail", "e\u0301\u0301le\u0300ve\u00a0 ok", "\u00a0\u00a0", "İstanbul123!? ~~", "antidisestablishment 中文字符"]
    df = plain(spark, list(enumerate(made)))
    for budget in (0, 1, 2, 3, 5):
        for r in token_counts.truncate(df, WORDS, budget).collect():
            t = made[r.doc_id]
            lengths = range(len(t), -1, -1) if len(t) < 100 else (3001,) if budget == 1 else ()
            for n in lengths:
                if len(ids(word_bpe, t[:n])) <= budget:
                    assert r.text == t[:n].rstrip(" \t\n\x0b\x0c\r") and r.n_tokens == len(ids(word_bpe, r.text)), (t, budget)
                    break


def test_bpe(spark, byte_bpe):
    got = bpe.encoded(table(spark), BYTES, P.PATTERN)
    want = []
    for i, t, *_ in awkward():
        found = byte_bpe.encode_ordinary(t or "")
        want.append((i, len(found), np.array(found, "<u4").tobytes(), byte_bpe.decode_bytes(found)))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    back = bpe.decoded(got, BYTES, P.PATTERN).collect()
    assert sorted((r.text for r in back)) == sorted(t or "" for _, t, *_ in awkward())
    digests = {r.ids_sha256 for r in bpe.encoded(table(spark), BYTES, P.PATTERN, digests=True).collect()}
    assert digests == {hashlib.sha256(x).hexdigest() for _, _, x, _ in want}
    assert bpe.encoded(empty(spark), BYTES, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_bpe_of_any_text(text):
    codec = _codec()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={}) if not _kept else _kept[0]
    _kept[:] = [enc]
    assert codec.encode([text])[0] == np.array(enc.encode_ordinary(text), "<u4").tobytes()


_kept, _made = [], []


def _codec():
    if not _made:
        _made.append(bpe.Codec(BYTES, P.PATTERN))
    return _made[0]


def places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for here in by.values():
        at = 0
        for offset, n in sorted(here):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, word_bpe):
    got = packing.packed(table(spark), WORDS, capacity=512, with_ids=True).collect()
    want = []
    for i, t, *_ in awkward():
        full = [*ids(word_bpe, t), 1]
        want += [(i, k, at, len(full[at : at + 512]), zlib.crc32(np.array(full[at : at + 512], "<u4").tobytes())) for k, at in enumerate(range(0, len(full), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    assert places(got, 512) <= 1.02 * -(-sum(r.length for r in got) // 512) + 1
    assert packing.packed(empty(spark), WORDS).count() == 0


def test_plan_is_best_fit():
    r = random.Random(3)
    for _ in range(30):
        sizes = [min(64, int(r.paretovariate(0.7)) + r.randint(0, 9)) for _ in range(r.randint(1, 400))]
        histogram = {n: sizes.count(n) for n in set(sizes)}
        placed = defaultdict(list)
        for run in packing.plan_best_fit(histogram, 64):
            for rank in range(run.first, run.beyond):
                k = rank - run.first
                placed[run.sequence + k // run.each].append((run.offset + k % run.each * run.length, run.length))
        assert sorted(n for x in placed.values() for _, n in x) == sorted(sizes)
        for x in placed.values():
            x.sort()
            assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 64
        rooms = []  # the same rule, document by document
        for n in sorted(sizes, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(64 - n)
        assert len(placed) == len(rooms)


def test_query_covers_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("op2_token_counts", "op6_byte_bpe"):
        assert catalog.QUERIES[name](spark, folder).count() == docs.count()
