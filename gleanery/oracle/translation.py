from __future__ import annotations

from gleanery.oracle.media import SQL as MEDIA
from gleanery.oracle.pages import WS

# The documents hold only plain text: each is one paragraph unit, or none when
# its emphasis marks or brackets do not pair up or a line is indented.
BARE = r"regexp_replace(regexp_replace(regexp_replace(text, '(?s)\\.', '', 'g'), 'https?://[^\s\]>)]+', '', 'g'), '([\p{L}\p{N}])_+([\p{L}\p{N}])', '\1\2', 'g')"


def count(s: str, mark: str) -> str:
    return f"len(regexp_extract_all({s}, '{mark}'))"


PLAIN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*|__|~~|\*|_', '', 'g'), '</?[A-Za-z][^>]*>', '', 'g'),"
    r" '\\([!-/:-@\[-`{-~])', '\1', 'g'), '" + WS + r"+', ' ', 'g'))"
)
UNITS = rf"""b AS (SELECT *, {BARE} AS t FROM documents),
u AS (SELECT doc_id, text, len(string_split(text, chr(10)))::INT AS lines, {PLAIN} AS seg FROM b
 WHERE {count('t', chr(92) + '[')} = {count('t', chr(92) + ']')} AND {count('t', chr(92) + '*' + chr(92) + '*')} % 2 = 0 AND {count("replace(t, '**', '')", chr(92) + '*')} % 2 = 0
  AND {count('t', '__')} % 2 = 0 AND {count("replace(t, '__', '')", '_')} % 2 = 0 AND {count('t', '~~')} % 2 = 0
  AND NOT regexp_matches(text, '(?m)^[ \t]') AND NOT contains(t, '`') AND regexp_matches(text, '\p{{L}}'))"""

ESCAPED = "up"
for _pattern, _to in (
    (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"(?m)^-", r"\\-"), (r"(?m)^\+ ", r"\\+ "), (r"(?m)^(=+)", r"\\\1"), (r"(?m)^(#{1,6}) ", r"\\\1 "),
    ("`", r"\\`"), (r"\[", r"\\["), (r"\]", r"\\]"), ("(?m)^>", r"\\>"), ("_", r"\\_"), (r"(?m)^([0-9]+)\. ", r"\1\\. "),
):
    ESCAPED = f"regexp_replace({ESCAPED}, '{_pattern}', '{_to}', 'g')"

LINES = "lines AS (SELECT doc_id, lang, source, unnest(range(len(s)))::INT AS line_no, unnest(s) AS segment FROM (SELECT *, string_split(text, chr(10)) AS s FROM documents))"
MEMORY = "memory AS (SELECT DISTINCT segment, reverse(segment) AS translation FROM lines WHERE lang = 'en' AND trim(segment) <> '')"
TRANSLATED = f"tr AS (SELECT l.*, CASE WHEN regexp_matches(l.segment, '^{WS}*$') THEN l.segment ELSE m.translation END AS translated FROM lines l LEFT JOIN memory m ON l.segment = m.segment)"

SQL = {
    "x3_document_units": f"""WITH {UNITS} SELECT doc_id, 0 AS unit_no, 'paragraph' AS kind, 0 AS start, lines - 1 AS "end", lines, [seg] AS segments FROM u""",
    "x4_interleave_translations": f"""WITH {UNITS}, x AS (SELECT doc_id, seg, reverse(seg) AS up FROM u)
SELECT d.doc_id, d.text || CASE WHEN x.up IS NOT NULL AND x.up <> x.seg THEN chr(10) || chr(10) || {ESCAPED} ELSE '' END AS document,
 CASE WHEN x.up IS NULL THEN 0 ELSE 1 END AS applied, 0 AS missing FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id""",
    "x3_structured_units": """WITH w AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[a-z]{3,}'), ['alpha', 'beta', 'gamma', 'delta', 'echo', 'fox']) AS w FROM documents)
SELECT doc_id, unnest(range(5))::INT AS unit_no, unnest(['heading', 'list-item', 'list-item', 'quote-paragraph', 'paragraph']) AS kind, unnest([0, 2, 3, 5, 7])::INT AS start, unnest([0, 2, 3, 5, 7])::INT AS "end",
 unnest([0, 2, 2, 0, 0])::INT AS indent, unnest([2, 0, 0, 0, 0])::INT AS level, unnest([[w[1] || ' ' || w[2]], [w[3] || ' one'], [w[4] || ' two'], [w[5] || ' ' || w[6]], [array_to_string(w, ' ')]]) AS segments FROM w""",
    "x4_changed_documents": """WITH w AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[a-z]{3,}'), ['alpha', 'beta', 'gamma', 'delta', 'echo', 'fox']) AS w FROM documents),
p AS (SELECT doc_id, w, w[3] || ' one' AS i1, w[4] || ' two' AS i2, w[5] || ' ' || w[6] AS q, array_to_string(w, ' ') AS t FROM w)
SELECT doc_id, concat_ws(chr(10), 'a new start', '', '## ' || w[1] || ' ' || w[2] || ' later', '', '- ' || i2, '- ' || i1 || chr(92), '  ' || reverse(i1), '', '> ' || q) ||
 CASE WHEN reverse(q) <> q THEN concat(chr(10), '>', chr(10), '> ', reverse(q)) ELSE '' END || chr(10) || chr(10) || t || CASE WHEN reverse(t) <> t THEN chr(10) || chr(10) || reverse(t) ELSE '' END AS document,
 3 AS applied, 2 AS missing FROM p""",
    "j13_translate_segments": f"WITH {LINES}, {MEMORY}, {TRANSLATED} SELECT doc_id, line_no, segment, translated FROM tr",
    "a5_translation_status": f"""WITH {LINES}, {MEMORY}, {TRANSLATED}, c AS (SELECT doc_id, any_value(lang) AS lang, count(translated) AS applied, count(*) AS total FROM tr GROUP BY 1),
s AS (SELECT *, CASE WHEN lang = 'es' THEN 'skipped' WHEN applied >= total THEN 'complete' WHEN applied > 0 THEN 'partial' ELSE 'failed' END AS status FROM c)
SELECT doc_id, applied, total, status, status = 'failed' AND total > 3 AS retryable FROM s""",
    "x8_language_gate": """WITH g AS (SELECT doc_id, n_chars, CASE lang WHEN 'de' THEN 'zh-Hant' WHEN 'fr' THEN 'zh' ELSE lang END AS lang, n_chars < 500 AS unsure,
  CASE WHEN doc_id < 500 THEN 'es' WHEN n_chars > 300 THEN 'zh' END AS target FROM documents)
SELECT doc_id, CASE WHEN NOT unsure THEN lang END AS lang, CASE WHEN target IS NULL THEN 'none' WHEN unsure THEN 'source-unknown' WHEN lang = target THEN 'skipped' ELSE 'translate' END AS action FROM g""",
    "x8_detect_language": rf"""WITH d AS (SELECT doc_id, (doc_id % 2)::INT AS fold, lang, string_split(' ' || lower(regexp_replace(text, '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS t,
  string_split(' ' || lower(regexp_replace(left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^{WS}*$')), chr(10)), 2000), '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS s FROM documents),
n AS (SELECT 1 - fold AS fold, lang, gram, count(*) AS n FROM (SELECT fold, lang, unnest(list_transform(range(1, greatest(len(t) - 1, 2)), lambda i: concat(t[i], t[i + 1], t[i + 2]))) AS gram FROM d) GROUP BY ALL),
p AS (SELECT fold, lang, gram, ln(n / sum(n) OVER (PARTITION BY fold, lang)) AS w FROM n),
g AS (SELECT doc_id, fold, gram, count(*) AS n FROM (SELECT doc_id, fold, unnest(list_transform(range(1, greatest(len(s) - 1, 2)), lambda i: concat(s[i], s[i + 1], s[i + 2]))) AS gram FROM d) GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS size FROM g GROUP BY 1),
h AS (SELECT g.doc_id, g.fold, p.lang, sum(g.n * (p.w + 12)) / any_value(z.size) AS score FROM g JOIN p ON g.gram = p.gram AND g.fold = p.fold JOIN z ON z.doc_id = g.doc_id GROUP BY 1, 2, 3)
SELECT doc_id, fold, max_by(lang, score) AS lang, round(1 / sum(exp((score - top) * 20)), 3) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM h) GROUP BY 1, 2""",
}

# the engine turns each piece around; a long line is several pieces
SQL["e1_with_engine"] = (
    MEDIA["x1_chunk_documents"]
    .replace("FROM documents", "FROM seg")
    .replace("WITH RECURSIVE ", f"WITH RECURSIVE {LINES}, seg AS (SELECT DISTINCT segment AS doc_id, segment AS text FROM lines), ", 1)
    .replace("SELECT g.doc_id, g.chunk_no, string_agg", ", c AS (SELECT g.doc_id, g.chunk_no, string_agg", 1)
    + rf"""), r AS (SELECT doc_id AS segment, string_agg(reverse(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')), ' ' ORDER BY chunk_no) AS t FROM c GROUP BY 1)
SELECT l.doc_id, line_no, lang AS source, 'en' AS target, l.segment,
 CASE WHEN regexp_matches(l.segment, '^{WS}*$') THEN l.segment WHEN lang = 'fr' THEN NULL ELSE r.t END AS translated,
 CASE WHEN lang = 'fr' AND NOT regexp_matches(l.segment, '^{WS}*$') THEN 'unsupported-pair' END AS error FROM lines l LEFT JOIN r ON l.segment = r.segment"""
)
