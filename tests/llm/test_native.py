"""Exact dedup, quality rules, sharding and preference pairs against plain Python and SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.llm import exact, hosts, preferences, shards
from tests.llm.cases import awkward, empty, plain, rows, table
from tools.check import TABLES, rows_of


@pytest.mark.parametrize("name", ["op3_warc", "op5_extendible_shards", "op7_preference_pairs", "op8_content_sort", "op10_host_rules"])
def test_twin(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rel.fetchall())


def test_exact(spark):
    groups = defaultdict(list)
    for i, t, *_ in awkward():
        groups[t or ""].append(i)
    got = exact.content_sort(table(spark), partitions=4).collect()
    assert len(got) == len(awkward())
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for t, ids in groups.items():
        here = by_sha[hashlib.sha256(t.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in here} == {keep} and {r.group_size for r in here} == {len(ids)}
        assert [r.doc_id for r in here if r.kept] == [keep]
    assert exact.content_sort(empty(spark)).count() == 0
    left = exact.drop_copies(table(spark))
    assert left.columns == table(spark).columns
    assert sorted(r.text or "" for r in left.collect()) == sorted(groups)


def test_exact_splits_a_hot_text(spark):
    df = plain(spark, [(i, "the same") for i in range(500)] + [(1000 + i, f"other {i}") for i in range(50)])
    got = exact.content_sort(df, partitions=8, runs=64).collect()
    assert [r.doc_id for r in got if r.kept and r.keep_id == 499] == [499] and sum(r.group_size == 500 for r in got) == 500


def measured(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_quality(spark):
    got = hosts.quality_rules(table(spark))
    want = [(i, *measured(t)) for i, t, *_ in awkward()]
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == sorted(want, key=repr)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert hosts.quality_rules(empty(spark)).count() == 0
    left = hosts.drop_failing(table(spark))
    assert left.columns == table(spark).columns and left.count() == got.filter("kept").count()


def test_bad_host_takes_its_documents_along(spark):
    good = "these are ten or more quite different words in one text of number "
    rows_ = [(i, good + f"n{i} and more", "en", f"h{i % 5}", 1) for i in range(100)] + [(200 + i, "few", "en", "bad", 1) for i in range(60)] + [(300, good + "z", "en", "bad", 1), (301, good + "y", "en", "new", 1)]
    got = {r.doc_id: r for r in hosts.quality_rules(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[300].base_failed and not got[300].kept and got[300].host_rate > 0.5
    assert got[301].kept and all(got[i].kept for i in range(100))


def test_shards(spark):
    limit = 2000
    got = shards.extendible_shards(table(spark), limit=limit).collect()
    assert len(got) == len(awkward()) and sum(r.n_bytes for r in got) == sum(len((t or "").encode()) for _, t, *_ in awkward())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for name, here in by.items():
        assert len(name) == here[0].depth and sum(r.n_bytes for r in here) == here[0].shard_bytes and len(here) == here[0].shard_docs
        assert here[0].fits or len({(r.doc_id, r.n_bytes) for r in here}) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # no bucket inside another
    assert {r.shard for r in shards.extendible_shards(table(spark)).collect()} == {""}
    assert shards.extendible_shards(empty(spark)).count() == 0


def test_written_shards(spark, tmp_path):
    df = table(spark, clash=False)
    shards.write_shards(df, str(tmp_path / "out"), limit=5000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.select(*df.columns)) == rows(df)


TURNS = "pair_id long, turn long, role string, text string, extra string"


def test_preferences(spark):
    a = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "good é", ""), (2, 0, "user", "x", ""), (2, 1, "assistant", None, ""), (3, 0, None, "only", ""), (None, 0, "user", "lost", ""), (4, None, "user", "q", ""), (4, 1, "assistant", "same", "")]
    b = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "bad", ""), (1, 3, "user", "why", ""), (1, 4, "assistant", "so", ""), (2, 0, "user", "y", ""), (4, None, "user", "q", ""), (4, 1, "assistant", "same", "")]
    got = {r.pair_id: r for r in preferences.preference_pairs(spark.createDataFrame(a, TURNS), spark.createDataFrame(b, TURNS)).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert (r.common_turns, r.usable) == (2, True)
    assert r.prompt == "<|system|>\ns\n<|end|>\n<|user|>\nu\n<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["good é\n<|end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["bad\n<|end|>\n", "so\n<|end|>\n"]
    assert got[2].common_turns == 0 and got[2].prompt == "" and not got[2].usable
    assert got[3].rejected == "" and got[3].chosen == "<||>\nonly\n<|end|>\n"
    assert got[4].common_turns == 2 and got[4].chosen == got[4].rejected == "" and not got[4].usable
    none = spark.createDataFrame([], TURNS)
    assert preferences.preference_pairs(none, none).count() == 0
