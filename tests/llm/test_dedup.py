"""Near-duplicates, suffix dedup and archives against brute force."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleanery.llm import graph, minmax, suffixes, warc
from tests.llm.cases import awkward, empty, plain, prose, rows, table


def shingles(t, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(rows, width, percent):
    """Smallest id reachable, per id."""
    sets = defaultdict(set)
    for i, t in rows:
        sets[i] |= {(0, x) for x in [frozenset(shingles(t, width))] if x}
    items = [(i, x) for i, xs in sets.items() for _, x in xs]
    to = {i: i for i, _ in rows}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[k + 1 :]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both) and root(i) != root(j):
                to[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in to}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups(spark, width, percent):
    got = minmax.near_groups(table(spark), width=width, percent=percent).collect()
    rows = [(i, t) for i, t, *_ in awkward()]
    assert len(got) == len(rows)
    want = groups([x for x in rows if x[0] is not None], width, percent)
    sizes = Counter((i, len(shingles(t, width))) for i, t in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert minmax.near_groups(empty(spark)).count() == 0


def test_near_groups_without_pivots(spark):
    """Blocks alone, so small that buckets need several, find what pivots find."""
    r = random.Random(5)
    base = prose(9, 200).split(" ")
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(50 + i, 80)) for i in range(20)]
    want = groups(rows, 3, 85)
    for options in ({"pivots": 0, "block": 7}, {"pivots": 1, "block": 5}, {}):
        got = {x.doc_id: x.component_id for x in minmax.near_groups(plain(spark, rows), **options).collect()}
        assert got == want


def test_signature_is_an_unbiased_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = minmax.signature(pool[:2000], 400), minmax.signature(pool[500:2500], 400)
    assert abs((a == b).mean() - 1500 / 2500) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (200, 200), (300, 299)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {103: 100, 101: 100, 300: 299}


def stripped(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in data for p in range(len(t) - length + 1))
    out = []
    for t in data:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(t, mark, strict=True) if not m)
        pieces = [t[m.start() : m.end()].decode("utf-8", "ignore") for m in re.finditer(b"\0+", bytes(mark))]
        out.append((len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest(), kept, "".join(pieces)))
    return out


@pytest.mark.parametrize(("length", "many", "unit"), [(200, 2000, 16), (64, 1, 4), (200, 0, 16)])
def test_suffixes(spark, length, many, unit):
    rows = [(i, t) for i, t, *_ in awkward() if len(t or "") < 40_000]
    r = random.Random(7)
    passage = prose(77, 90)
    for k in range(25):
        a, b = sorted(r.sample(range(len(passage)), 2))
        rows.append((100 + k, prose(200 + k, r.randint(0, 25)) + passage[a:b] + prose(300 + k, r.randint(0, 25))))
    want = [(i, *x[:5]) for (i, _), x in zip(rows, stripped([t for _, t in rows], length), strict=True)]
    got = suffixes.without_repeats(plain(spark, rows).repartition(3), length=length, many=many, unit=unit).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in got), key=repr) == sorted(want, key=repr)


def test_suffix_groups_are_bounded(spark, monkeypatch):
    """A passage that many texts hold makes no group of a row per text that is sorted in one task."""
    passage = prose(78, 150)
    rows = [(k, prose(400 + k, 12) + passage + prose(500 + k, 12)) for k in range(40)]
    sort = suffixes.repeated_offsets

    def bounded(groups, *others):
        assert np.unique(groups, return_counts=True)[1].max() <= 8
        return sort(groups, *others)

    monkeypatch.setattr(suffixes, "HELD", 8, raising=False)
    monkeypatch.setattr(suffixes, "repeated_offsets", bounded)
    got = suffixes.without_repeats(plain(spark, rows).repartition(3), many=0).collect()
    want = [(i, *x[:5]) for (i, _), x in zip(rows, stripped([t for _, t in rows], 200), strict=True)]
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in got) == want


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    p = prose(8, 100)
    data = [(prose(9, 300) + p + prose(10, 200) + p).encode(), (p + prose(11, 50)).encode()]
    found = defaultdict(list)
    for row, h, c, x, lo, hi in suffixes.anchored_runs(data):
        for a, b in zip((x - hi).tolist(), (x - lo).tolist(), strict=True):
            found[row] += range(a, b + 1)
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(len(t) - 199)) for k, t in enumerate(data)}


def test_suffix_table(spark):
    df = table(spark)
    left = suffixes.strip_repeats(df)
    assert left.columns == df.columns
    want = stripped([t for _, t, *_ in awkward()], 200)
    assert rows(left.select("doc_id", "text")) == sorted(((r[0], None if r[1] is None else x[5]) for r, x in zip(awkward(), want, strict=True)), key=repr)


def test_cut_characters_go_and_none_appear(spark):
    """A passage cut inside characters of two to four bytes, at both ends: no halves meet."""
    cuts = [("ĩ", "ê", "é", "è"), ("ガ", "€", "€", "₩"), ("😀", "😀", "𐘀", "🤀"), ("ĩ", "€", "é", "₩"), ("x", "ê", "y", "è")]
    texts_ = []
    for k, (a, b, c, d) in enumerate(cuts):
        passage = prose(500 + k, 90)
        texts_ += [f"uniq{k} {a}{passage}{b} tail{k}", f"other{k} {c}{passage}{d} end{k}"]
    df = plain(spark, list(enumerate(texts_)))
    want = stripped(texts_, 200)
    assert any(x[4].decode("utf-8", "ignore") != x[5] for x in want)  # joined first, some halves would be a character
    got = {r.doc_id: r.text for r in suffixes.strip_repeats(df).collect()}
    assert [got[i] for i in range(len(texts_))] == [x[5] for x in want]
    assert all(set(got[i]) <= set(t) and len(got[i]) < 40 for i, t in enumerate(texts_))


def test_near_copies_of_awkward_rows(spark):
    df = table(spark)
    left = minmax.drop_near_copies(df, width=5, percent=80)
    assert left.columns == df.columns
    kept = groups([(r[0], r[1]) for r in awkward() if r[0] is not None], 5, 80)
    want = [(r[0], r[1]) for r in awkward() if r[0] is None or kept[r[0]] == r[0]]
    assert rows(left.select("doc_id", "text")) == sorted(want, key=repr)
    assert minmax.drop_near_copies(empty(spark)).count() == 0


def test_empty_suffixes(spark):
    assert suffixes.without_repeats(empty(spark)).count() == 0
    assert suffixes.strip_repeats(empty(spark)).count() == 0


def test_deep_shallow_orders_and_measures():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(80)) for _ in range(60)]
    strings += [s[:70] + bytes(r.choice(b"abc") for _ in range(10)) for s in strings[:20] for _ in range(4)] + strings[:9]
    matrix = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), 80)
    sides = np.array([i % 2 for i in range(len(strings))])
    order, common = suffixes.deep_shallow(matrix, sides, shallow=16)
    assert [(sides[i], strings[i]) for i in order] == sorted((sides[i], s) for i, s in enumerate(strings))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        same = next((j for j in range(80) if a[j] != b[j]), 80)
        assert common[k] == (same if sides[order[k - 1]] == sides[order[k]] else -1)


PAGES = "page_id long, url string, html string, archive string"


def test_warc(spark, tmp_path):
    big, other = "<p>" + "é" * 600, "<p>" + "x" * 1500
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "http://c", big), (4, "http://d", other), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "n", other), (9, "v", "line\r\n\r\nline"), (3, "http://c", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    folder = warc.located(str(tmp_path / "arc"))
    index = warc.write_archives(pages, folder, archive_bytes=300)
    assert index.count() == len(rows) and index.select("archive").distinct().count() > 3
    got = warc.read_records(index, folder, with_payload=True).collect()
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        first = max((j for j, _, g in rows if g == h and j is not None), default=None)
        revisit = len(data) >= 1000 and i != first
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, b"" if revisit else data] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    some = warc.read_records(index.filter("page_id in (4, 9)"), folder).collect()
    assert sorted(r.page_id for r in some) == [4, 9]
    for f in (tmp_path / "arc").iterdir():
        if f.name.endswith(".warc.gz"):
            assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_damaged_record_is_noticed():
    row = {"page_id": 1, "url": "u", "html": b"text", "payload_bytes": 4, "payload_digest": hashlib.sha1(b"other").hexdigest(), "record_type": "response", "refers_to": None}
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc.record(row))
