"""Registered queries against their SQL twins, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

NAMES = [
    "flagship_site_report", "p2_page_meta", "p3_page_links", "p6_route_items", "p10_clip_documents", "j1_saved_lookup", "j3_media_kinds", "j5_same_site_links",
    "j6_resolve_short_links", "j8_apply_edits", "j10_reconcile_library", "a2_collect_quotes", "a3_thread_documents", "a7_distinct_media", "w1_latest_per_source",
    "w5_retain_last", "w7_admit_by_budget", "u1_locate_clips", "u2_pending_minus_done", "x1_chunk_documents", "x7_table_markdown", "p8_stream_page_meta", "x8_language_gate",
    "st3_stream_threads", "st8_stream_generation_guard",
]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
