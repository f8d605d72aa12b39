"""The pipeline against its stages worked out by hand."""

import re

import corpus_pipeline as pipeline
from tests.llm.cases import empty, prose
from tests.llm.test_dedup import groups, stripped
from tests.llm.test_native import measured

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    a, b, passage = prose(1, 200), prose(2, 300), prose(3, 70)
    rows = [(1, a), (2, a), (3, b), (4, b + " end"), (5, None), (6, "few words"), (7, prose(4, 50) + passage + prose(5, 40)), (8, prose(6, 60) + passage + prose(7, 20)), (9, prose(8, 90)), (10, "again and again and so it goes " * 9)]
    return [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows]


def test_stages(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    rows = {i: t for i, t, *_ in documents()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, "")
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k == 0:
            rows = {i: t for i, t in rows.items() if (m := measured(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
        elif k == 1:
            rows = {i: t for i, t in rows.items() if i == max(j for j, u in rows.items() if u == t)}
        elif k == 2:
            kept = groups(list(rows.items()), 5, 80)
            rows = {i: t for i, t in rows.items() if kept[i] == i}
        elif k == 3:
            rows = {i: x[5] for i, x in zip(rows, stripped(list(rows.values()), 200), strict=True)}
        if k < len(pipeline.STAGES) - 1:
            assert {r.doc_id: r.text for r in docs.collect()} == rows, name
    got = docs.collect()
    assert {r.doc_id for r in got} == set(rows) and len({r.sequence_id for r in got}) == 1
    assert 1 not in rows and 4 not in rows and len(rows[7]) < len(documents()[6][1])
    assert re.fullmatch(r"\w[\w -]*", pipeline.STAGES[0][0])


def test_empty(spark):
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
