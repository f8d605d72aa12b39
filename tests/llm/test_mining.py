"""Collocations, conversation tries and SimHash classes against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations
from math import floor

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.llm import collocations, conversation_trie, simhash
from tests.llm.cases import CLASHES, awkward, empty, plain, rows, table
from tools.check import TABLES, rows_of


@pytest.mark.parametrize("name", ["op11_collocations", "op12_conversation_trie"])
def test_twin(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rel.fetchall())


def mined(docs, support, most, top, inside):
    """Collocations by plain counting; ``docs`` are (lang, text)."""
    total, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    f = {p: n for p, n in f.items() if n >= support}
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(g == lang and len(q) > len(p) and 100 * n >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), n in f.items()):
            continue
        cuts = [(floor(Fraction(1_000_000 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    made = []
    for lang in {x[0] for x in out}:
        for rank, (_, score, a, p, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            made.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(made, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["new", "york", "City", "the", "of", "and", "é", "don't", "x7", "tab\tbed", "stop.", "go;", "line\nbreak", "a\x0bb"]
    out = [(r.choice(["en", "fr", None, "und"]), " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for _ in range(n)]
    return out + [("en", None), ("fr", ""), ("en", " \t.\n"), ("xx", "only once"), ("en", "new york city " * 400), ("zz", "ab " * 20_000)]


@pytest.mark.parametrize("options", [{}, {"support": 3, "shards": 1}, {"support": 5, "shards": 7, "max_words": 4, "filter_bits": 64}, {"support": 2, "shards": 5, "max_words": 2, "top": 4, "inside_percent": 90}])
def test_collocations(spark, options, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 3000)  # many slices, so many shards have some of each phrase
    data = corpus(1, 120)
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, (g, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in [*CLASHES, "phrase", "a", "n", "key", "size"]})
    want = mined(data, options.get("support", 10), options.get("max_words", 3), options.get("top", 2000), options.get("inside_percent", 50))
    assert len(want) > 5
    assert rows(collocations.collocations(df, **options)) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(plain(spark, [(1, None), (2, ""), (3, " . ")])).count() == 0


def test_large_products_are_exact(spark):
    a, left, right = 3_000_000_019, 5_000_000_029, 4_000_000_007
    made = [("en", 0, "", 10**13), ("en", 2, "p q", a), ("en", 1, "p", left), ("en", 1, "q", right)]
    counts = spark.createDataFrame(made, "lang string, size int, phrase string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "phrase_counts", lambda docs: counts)
        (r,) = collocations.collocations(counts).collect()
    assert tuple(r) == ("en", 1, "p q", a, left, right, 10**13, 1_000_000 * a * a // (left * right))


def built(turns):
    """Rebuilt conversations of (conv, turn, role, text) rows, as the contract has it."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return own, out


def trie(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(set)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    made = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        leaves = sum(not children[x] for x in below)
        made.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(made, key=repr)


TURNS = "conv_id long, turn long, role string, text string, node string, leaf string, pos string"


def test_tries(spark):
    r = random.Random(4)
    turns = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 240)]:
        turns += [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, "longer text"])) for t in range(r.choice([0, 1, 2, 3, 8]))]
    turns += [(7, None, "user", "first"), (7, None, "user", "first"), (9, 1, "tie", "b"), (9, 1, "tie", "a"), (None, 0, "user", "lost")]
    turns += [(50, t, "user", f"turn {t % 3}") for t in range(3000)] + [(51, t, "user", f"turn {t % 3}") for t in range(2990)] + [(52, 0, "x", "y" * 200_000)]
    df = spark.createDataFrame([(*t, "x", "y", "z") for t in turns], TURNS).repartition(5)
    own, convs = built(turns)
    assert any(not v for v in convs.values())  # some have no turns left
    short = {c for c in convs if c not in (50, 51)}
    got = [x for x in rows(conversation_trie.rebuilt_trie(df.filter("coalesce(conv_id, 0) not in (50, 51)")).drop("node", "parent"))]
    assert got == trie({c: convs[c] for c in short})
    plain_ones = rows(conversation_trie.conversation_trie(df.filter("coalesce(conv_id, 0) not in (50, 51)")).drop("node", "parent"))
    assert plain_ones == trie({c: own[c] for c in short})
    long = conversation_trie.conversation_trie(df.filter("conv_id in (50, 51)")).drop("node", "parent").orderBy("depth").collect()
    assert len(long) == 3001 and long[0].saved_tokens == 2990 * 6 and long[0].n_leaves == 1 and [x.n_convs for x in long[2989:2992]] == [2, 2, 1]
    assert conversation_trie.rebuilt_trie(df.limit(0)).count() == 0


def test_end_lists_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 60)
    ends = spark.range(500).selectExpr("unhex(if(id % 5 = 0, '01', '02')) AS node", "id * 7 AS conv_id").repartition(6)
    got = {bytes(x.node): x.ends_sha256 for x in conversation_trie.end_lists(ends).collect()}
    for node, ids in ((b"\x01", range(0, 500, 5)), (b"\x02", [i for i in range(500) if i % 5])):
        assert got[node] == hashlib.sha256(",".join(str(7 * i) for i in ids).encode()).hexdigest()


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, bits=3):
    """Component of every print: all pairs, by plain search."""
    at = sorted(set(prints))
    group = {p: p for p in at}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(at, 2):
        if (a ^ b).bit_count() <= bits:
            group[root(a)] = root(b)
    return {p: root(p) for p in at}


def test_simhash(spark, monkeypatch):
    base = [w for w in awkward()[13][1].split(" ")[:400]]
    more = [(100 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(60)]
    more += [(200 + i, "three little words") for i in range(5)] + [(None, "three little  WORDS"), (None, "no other is like this"), (300, None), (None, "")]
    data = [(r[0], r[1]) for r in awkward()] + more
    df = plain(spark, data).repartition(3).withColumns({c: F.lit("x") for c in [*CLASHES, "print", "fingerprint", "key"]})
    prints = [fingerprint(t) for _, t in data]
    group = classes(prints)
    least = defaultdict(list)
    for (i, _), p in zip(data, prints, strict=True):
        if i is not None:
            least[group[p]].append(i)
    want = sorted(((i, f"{p:016x}", min(least[group[p]], default=None)) for (i, _), p in zip(data, prints, strict=True)), key=repr)
    for block in (simhash.BLOCK, 2):
        assert rows(simhash.simhash_classes(df, block=block)) == want
    monkeypatch.setattr(simhash.stretches, "__defaults__", (64,))
    assert rows(simhash.simhash_classes(df)) == want
    assert simhash.simhash_classes(empty(spark)).count() == 0


@pytest.mark.parametrize(("bits", "shared", "block"), [(3, 4, 1024), (3, 4, 3), (3, 1, 8), (2, 5, 4), (1, 7, 4)])
def test_links_of_prints(spark, bits, shared, block):
    """Crowded balls of prints, chains and strangers: components as by all pairs."""
    r = random.Random(bits * 100 + block)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = {0, (1 << 64) - 1, *(r.getrandbits(64) for _ in range(80))}
    for c in centres:
        for _ in range(60):
            prints.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
        x = c
        for _ in range(25):
            x ^= sum(1 << b for b in r.sample(range(64), bits or 1))
            prints.add(x)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    labels = simhash.print_labels(spark.createDataFrame([(p,) for p in signed], "print long"), max_bits=bits, shared=shared, block=block)
    got = {x.node: x.label for x in labels.collect()} if labels is not None else {}
    want = defaultdict(list)
    group = classes(prints, bits)
    for p in prints:
        want[group[p]].append(int(np.uint64(p).view(np.int64)))
    assert {p: got.get(p, p) for p in signed} == {p: min(v) for v in want.values() for p in v}


def test_posting_lists_are_not_broadcast(spark, monkeypatch):
    """Postings are 35 rows a print, which the planner does not see: a small table of prints must not have them sent to the driver."""
    plans, written = {}, simhash.written

    def kept(df, name):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString())
        return written(df, name)

    monkeypatch.setattr(simhash, "written", kept)
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(20)]
    prints = written(spark.createDataFrame([(p,) for b in base for p in {b, b ^ 1, b ^ 5 << 40, b ^ 21 << 8}], "print long"), "prints")
    labels = simhash.print_labels(prints)
    assert labels.count() == 60
    assert "Broadcast" not in plans["posting-lists"]
    members = written(spark.createDataFrame([(1, p, p % 3) for p in base], "key long, print long, label long"), "members")
    assert "Broadcast" not in simhash.linked_in_blocks(members, max_bits=3)._jdf.queryExecution().sparkPlan().toString()
