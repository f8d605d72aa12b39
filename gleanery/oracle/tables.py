from __future__ import annotations

from gleanery.oracle.pages import TITLE

WORDS = r"""w AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS ws FROM pages WHERE contains(html, '<article>')),
ww AS (SELECT page_id, ws, coalesce(ws[1], '-') AS w0, coalesce(ws[2], '-') AS w1, coalesce(ws[3], '-') AS w2 FROM w),
l AS (SELECT page_id, unnest(range(len(ws)))::INT AS i, unnest(ws) AS x FROM ww)"""


def _cell(table, row, col, text, *, cs="1", rs="1", rcs="1", rrs="1", section="''", head="false", nested="false", block="false", incoming="false", source="ww"):
    return (
        f"SELECT page_id, {table} AS table_no, {row} AS row, {col} AS col, {cs} AS colspan, {rs} AS rowspan, {rcs} AS raw_colspan, {rrs} AS raw_rowspan, {section} AS section,"
        f" {head} AS is_header, {block} AS has_block, {nested} AS nested, {incoming} AS incoming, {text} AS text FROM {source}"
    )


CELLS = WORDS + ", cells AS (" + " UNION ALL ".join(
    [
        _cell(0, 0, 0, "'Word'", section="'thead'", head="true"),
        _cell(0, 0, 1, "'No'", section="'thead'", head="true"),
        _cell(0, "i + 1", 0, "trim(x) || '|'", section="'tbody'", source="l"),
        _cell(0, "i + 1", 1, "i::VARCHAR", section="'tbody'", source="l WHERE i > 0"),
        _cell(1, 0, 0, "w0", cs="2", rcs="2"),
        _cell(1, 1, 0, "'a'"), _cell(1, 1, 1, "w1"), _cell(1, 2, 0, "'b'"), _cell(1, 2, 1, "w2 || '<br>x'"),
        _cell(2, 0, 0, "w0", rs="2", rrs="3"), _cell(2, 0, 1, "'1'"),
        _cell(2, 1, 1, "'2'", incoming="true"), _cell(2, 1, 2, "w1", cs="2", rcs="2", incoming="true"),
        _cell(3, 0, 0, "w0", nested="true", block="true"), _cell(3, 1, 0, "'z'"),
    ]
) + ")"

NL = "chr(10)"
SQL = {
    "x5_table_cells": f"WITH {CELLS} SELECT * FROM cells",
    "x6_table_kinds": f"""WITH {WORDS}, t AS (SELECT page_id, len(ws) AS n FROM ww)
SELECT page_id, 0 AS table_no, CASE WHEN n = 0 THEN 'layout' ELSE 'grid' END AS kind, 2 AS columns, n + 1 AS rows, 0 AS leading, 0 AS trailing, true AS header FROM t
UNION ALL SELECT page_id, 1, 'grid', 2, 2, 1, 0, false FROM t UNION ALL SELECT page_id, 2, 'html', 4, 2, 0, 0, false FROM t UNION ALL SELECT page_id, 3, 'layout', 1, 2, 0, 0, false FROM t""",
    "x7_table_markdown": f"""WITH {WORDS}, r AS (SELECT page_id, string_agg('| ' || replace(trim(x) || '|', '|', '\\|') || ' | ' || CASE WHEN i > 0 THEN i::VARCHAR ELSE ' ' END || ' |', {NL} ORDER BY i) AS lines FROM l GROUP BY 1)
SELECT page_id, 0 AS table_no, '| Word | No |' || {NL} || '| --- | --- |' || {NL} || lines AS markdown FROM r
UNION ALL SELECT page_id, 1, '|   |   |' || {NL} || '| --- | --- |' || {NL} || '| a | ' || w1 || ' |' || {NL} || '| b | ' || w2 || '<br>x |' FROM ww""",
    "p8_stream_page_meta": f"""WITH v AS (SELECT page_id, url, md5(url) AS h, length(url) AS n, length(html)::DOUBLE AS size, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '["\\\\]', '', 'g') AS t, {TITLE} AS plain FROM pages WHERE contains(html, '</head>')),
k AS (SELECT *, n % 2 = 0 AS tube, NOT (n % 2 = 0 AND n % 3 = 0) AS hit,
 CASE WHEN n % 2 = 0 THEN 'https://www.youtube.com/watch?v=' || h[1:11] WHEN n % 3 = 0 THEN 'https://www.bilibili.com/video/av' || page_id ELSE 'https://www.bilibili.com/video/BV' || h[1:10] END AS addr FROM v)
SELECT page_id, addr AS url, CASE WHEN hit THEN 'full' ELSE 'partial' END AS state, CASE WHEN hit AND trim(t) <> '' THEN trim(t) WHEN hit AND plain <> '' THEN plain ELSE addr END AS title,
 CASE WHEN NOT hit THEN '' WHEN tube THEN 'An {{Author}}' ELSE 'Up' END AS author, CASE WHEN NOT hit THEN '' WHEN tube THEN 'De' || chr(10) || 'scription' ELSE 'about' END AS description,
 CASE WHEN NOT hit THEN '' WHEN tube THEN '2024-05-06T00:00:00.000Z' ELSE '2023-11-14T22:13:20.000Z' END AS published,
 CASE WHEN NOT hit THEN '' WHEN tube THEN 'https://www.youtube.com/c.jpg' ELSE 'https://i.example/p.jpg' END AS cover, CASE WHEN hit THEN size END AS duration,
 CASE WHEN tube THEN 'https://www.youtube.com/embed/' || h[1:11] WHEN n % 3 = 0 THEN 'https://player.bilibili.com/player.html?aid=' || page_id ELSE 'https://player.bilibili.com/player.html?bvid=BV' || h[1:10] END AS embed,
 CASE WHEN tube AND n % 3 = 0 THEN ['elsewhere00'] WHEN tube THEN [h[1:11]] ELSE ['BV' || h[1:10], 'av' || page_id] END AS video_ids FROM k""",
}
