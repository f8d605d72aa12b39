from __future__ import annotations

from gleanery.oracle.plain import plain
from gleanery.oracle.pages import WS


def trim(s: str) -> str:
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def paragraphs(s: str) -> str:
    """The turns hold no blank lines, so each is one paragraph."""
    return f"array_to_string(list_filter(list_transform(string_split({s}, chr(10)), lambda x: {trim('x')}), lambda x: x <> ''), '\\' || chr(10))"


def quoted(s: str) -> str:
    return f"'> ' || replace({s}, chr(10), chr(10) || '> ')"


PLAIN = plain("text")
CLOCK = "CASE WHEN n >= 3600 THEN (n // 3600) || ':' || lpad((n % 3600 // 60)::VARCHAR, 2, '0') ELSE (n // 60)::VARCHAR END || ':' || lpad((n % 60)::VARCHAR, 2, '0')"
NL2 = "chr(10) || chr(10)"

POSTS = f"""posts AS (SELECT conv_id::VARCHAR AS thread_id, turn::INT AS pos, (conv_id * 100 + turn)::VARCHAR AS id, length(text) AS n, text, role,
  CASE WHEN length(text) < 150 THEN 'other' WHEN turn % 2 = 0 THEN 'AUTHOR' ELSE 'author' END AS handle, 'https://x.com/author/status/' || (conv_id * 100 + turn) AS url,
  length(text) % 4 = 0 AS brk FROM conversations),
focal AS (SELECT thread_id, min(pos) AS at FROM posts WHERE handle <> 'other' GROUP BY 1),
run AS (SELECT p.* FROM posts p JOIN focal f USING (thread_id) WHERE p.handle <> 'other'
  AND NOT EXISTS (SELECT 1 FROM posts q WHERE q.thread_id = p.thread_id AND q.handle = 'other' AND q.pos BETWEEN least(p.pos, f.at) AND greatest(p.pos, f.at))
  AND NOT EXISTS (SELECT 1 FROM posts q WHERE q.thread_id = p.thread_id AND q.brk AND q.pos > p.pos AND q.pos <= f.at))"""

VIDEO = f"""'![](https://p.example/' || id || '.png)' || {NL2} || '[▶ Video (' || {CLOCK} || ')](' || url || '/video/1)'"""
QUOTE = quoted(
    f"""concat_ws({NL2}, '**Some \\*One\\* (@one)** · 2024-05-06 · [Post](https://x.com/one/status/9' || id || ')',
  'quoted' || {NL2} || 'text' || CASE WHEN n % 3 = 0 THEN ' … [Full post](https://x.com/one/status/9' || id || ')' ELSE '' END, {VIDEO})"""
)
POST_MD = f"""concat_ws({NL2}, nullif({paragraphs('text')} || CASE WHEN n % 7 = 0 THEN ' … [Full post](' || url || ')' ELSE '' END, ''),
  CASE WHEN n % 2 = 0 THEN '![](https://p.example/' || id || '%281%29.jpg)' END, CASE WHEN n % 5 = 0 THEN {VIDEO} END,
  CASE WHEN n % 13 = 0 THEN '[A \\[card\\]](https://c.example/)' END, CASE WHEN n % 11 = 0 THEN regexp_replace({QUOTE}, '(?m)^> $', '>', 'g') END)"""

QUOTES = f"""q AS (SELECT conv_id * 100 + turn AS id, 'https://q.example.com/' || conv_id AS source, 'Page  ' || conv_id AS title,
  make_timestamp((1704067200 + conv_id * 3600 + turn // 3 * 60 + turn % 3) * 1000000) AS ts, CASE WHEN role = 'user' THEN '#:~:text=a%20%28b%29' ELSE '' END AS frag, text FROM conversations),
a0 AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M') AS minute, row_number() OVER (PARTITION BY source, strftime(ts, '%Y-%m-%d %H:%M'), frag ORDER BY ts, id) AS k FROM q),
a AS (SELECT *, minute || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || ' · [Jump to source](' || source || frag || ')' AS anchor FROM a0),
e AS (SELECT *, regexp_replace({quoted(trim('text'))}, '(?m)^>[ \\t]+$', '>', 'g') || {NL2} || anchor AS entry, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS rn FROM a)"""

CLIPS = """clips AS (SELECT doc_id::VARCHAR AS id, CASE WHEN n_chars % 10 = 0 THEN 'other' ELSE doc_id::VARCHAR END AS file_id, lang = 'de' AS media,
  CASE WHEN lang = 'de' THEN doc_id || '.jpg' ELSE 'edited ' || doc_id || '.md' END AS file, split_part(text, chr(10), 1) AS title, [lang, source] AS tags, '' AS note FROM documents),
ed AS (SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 1 THEN CASE WHEN doc_id < 300 THEN 'Edited ' || doc_id ELSE 'New: ' || doc_id END END AS t,
  CASE WHEN toxic = 1 THEN ['toxic', quality::VARCHAR] END AS g, CASE WHEN quality = 0 THEN '' ELSE 'checked' END AS n FROM labels)"""

SQL = {
    "w3_thread_ranges": f'WITH {POSTS} SELECT thread_id, min(pos) AS start, max(pos) AS "end", count(*) AS n, count(*) > 50 AS "limit" FROM run GROUP BY 1',
    "a3_thread_documents": f"""WITH {POSTS}, k AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos) AS rn, {PLAIN} AS plain FROM run),
r AS (SELECT *, {POST_MD} AS md FROM k WHERE rn <= 50)
SELECT thread_id, CASE WHEN count(*) > 1 THEN 'thread' ELSE 'post' END AS form, count(*) AS posts,
 sum(CASE WHEN n % 7 = 0 OR (n % 11 = 0 AND n % 3 = 0) THEN 1 ELSE 0 END) AS truncated, false AS "limit", sum(CASE WHEN n % 7 = 0 OR (n % 11 = 0 AND n % 3 = 0) THEN 1 ELSE 0 END) > 0 AS partial,
 '@' || min_by(handle, rn) || ' - ' || left(min_by(plain, rn), 30) AS title, string_agg(md, {NL2} ORDER BY rn) AS markdown FROM r GROUP BY 1""",
    "j6_resolve_short_links": f"""WITH l AS (SELECT md5(text)[1:8] AS s, min('https://example.com/a/(' || conv_id || ')') AS u FROM conversations WHERE role = 'assistant' GROUP BY 1),
t AS (SELECT conv_id * 100 + turn AS post_id, role, turn, text AS head, md5(text)[1:8] AS s FROM conversations),
g AS (SELECT t.*, coalesce(l.u, CASE WHEN role = 'system' THEN 'https://sys.example.com/' || turn ELSE 'https://t.co/' || t.s END) AS target FROM t LEFT JOIN l ON t.s = l.s)
SELECT post_id, {trim("head || ' ' || '[' || replace(target, 'https://', '') || '](' || replace(replace(target, '(', '%28'), ')', '%29') || ') [@' || role || '](https://x.com/' || role || ') [#' || role || '](https://x.com/hashtag/' || role || ')'")} AS expanded FROM g""",
    "p12_post_videos": f"""WITH {POSTS}
SELECT '9' || id AS post_id, 1 AS n, 'https://x.com/one/status/9' || id || '/video/1' AS url, '@one - quoted text' AS title, 'Some *One* (@one)' AS author,
 'https://p.example/' || id || '.png' AS cover, n AS duration, 'quoted' || {NL2} || 'text' AS description FROM posts WHERE n % 11 = 0
UNION ALL SELECT id, 7, 'https://x.com/' || handle || '/status/' || id || '/video/7', '@' || handle || ' - ' || left({PLAIN}, 30), upper(role[1]) || role[2:] || ' (@' || handle || ')',
 'https://p.example/' || id || '.png', n, {paragraphs('text')} FROM posts WHERE n % 11 <> 0 AND n % 5 = 0""",
    "w6_thread_merge": """SELECT conv_id::VARCHAR AS list_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn::VARCHAR AS id, role AS handle, length(text) % 4 = 0 AS break_before FROM conversations""",
    "w6_thread_merge_chain": """WITH e AS (SELECT event_type AS list_id, event_id AS id, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
c AS (SELECT *, count(*) FILTER (WHERE next % 2 = 0) OVER (PARTITION BY list_id ORDER BY k) AS above, count(*) FILTER (WHERE next % 2 = 1) OVER (PARTITION BY list_id ORDER BY k) AS below FROM e WHERE n > 1)
SELECT list_id, CASE WHEN next % 2 = 0 THEN above WHEN next IS NULL THEN above + 1 ELSE n - below + 1 END AS position, id::VARCHAR AS id, 's' || least(k, n - 1) AS handle, false AS break_before FROM c""",
    "w4_quote_anchors": f"WITH {QUOTES} SELECT id, anchor FROM a",
    "a2_collect_quotes": f"""WITH {QUOTES}, p AS (SELECT source, (rn - 1) // 1000 AS part, string_agg(entry, {NL2} ORDER BY rn) AS body, min_by(title, rn) AS title, min(ts) AS ts FROM e GROUP BY 1, 2),
n AS (SELECT source, count(*) AS entries FROM q GROUP BY 1)
SELECT source, part, entries, CASE WHEN part = 0 THEN concat_ws(chr(10), '---', 'id: "' || source || '"', 'source: "' || source || '"', 'medium: "quote"', 'title: "' || title || '"',
 'author: ""', 'published: ""', 'captured: "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '"', 'site: "q.example.com"', 'tags: []', 'note: ""', 'extract: "full"', '---', '',
 '# Quotes - ' || replace(title, '  ', ' '), '', '[Source](' || source || ')', '', body, '') ELSE chr(10) || body || chr(10) END AS document FROM p JOIN n USING (source)""",
    "a2_quote_entries": f"WITH {QUOTES}, e2 AS (SELECT source, (rn - 1) // 1000 AS part, rn FROM e) SELECT source, part, count(*) AS found FROM e2 GROUP BY 1, 2",
    "w4_fragment_urls": """WITH w AS (SELECT conv_id, turn, turn % 3 AS form, list_concat(regexp_extract_all(text, '[a-z]+'), ['one', 'two', 'three']) AS w FROM conversations)
SELECT conv_id, turn, 'https://q.example.com/' || conv_id || CASE form WHEN 0 THEN '#top' WHEN 1 THEN '#a' ELSE '#' END || ':~:text=' || CASE WHEN form = 2 THEN w[3] || '-,' ELSE '' END || w[1] || '%2C%20' || w[2] || '%2D' ||
 CASE WHEN form <> 1 THEN ',' || array_to_string(w, '%20') ELSE '' END || CASE WHEN form = 0 THEN ',-' || w[3] ELSE '' END AS url FROM w""",
    "a2_quote_notes": f"WITH {QUOTES} SELECT id, entry || {NL2} || title || {NL2} || '> next' || {NL2} || 'next anchor' || chr(10) AS document, anchor, title AS note FROM e",
    "j11_quote_targets": """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id * 100 + turn AS id, 'https://q.example.com/' || conv_id AS source, CASE WHEN n > 3 THEN 'append' ELSE 'new' END AS target, CASE WHEN n > 3 THEN conv_id END AS file_id, n IN (2, 3) AS recreated
FROM conversations JOIN c USING (conv_id)""",
    "j8_apply_edits": f"""WITH {CLIPS}, x AS (SELECT c.*, t, g, n, ed.id IS NOT NULL AS has, c.id <> c.file_id AS bad FROM clips c LEFT JOIN ed USING (id)),
f AS (SELECT *, has AND NOT bad AND NOT media AND t IS NOT NULL AND t <> title AS dt, has AND NOT bad AND g IS NOT NULL AND g <> tags AS dg, has AND NOT bad AND n <> note AS dn FROM x)
SELECT id, CASE WHEN dt THEN t ELSE title END AS title, CASE WHEN dg THEN g ELSE tags END AS tags, CASE WHEN dn THEN n ELSE note END AS note,
 list_filter([CASE WHEN dt THEN 'title' END, CASE WHEN dg THEN 'tags' END, CASE WHEN dn THEN 'note' END], lambda v: v IS NOT NULL) AS changed,
 CASE WHEN has AND bad THEN 'rejected' WHEN dt OR dg OR dn THEN 'changed' ELSE 'unchanged' END AS status,
 CASE WHEN dt AND lower(t || '.md') <> lower(file) THEN replace(t, ':', '-') END AS rename FROM f""",
    "j9_merge_edits": f"""WITH {CLIPS} SELECT c.id, CASE WHEN t IS NOT NULL AND t <> title THEN t ELSE 'In ' || c.id END AS title, CASE WHEN g IS NOT NULL AND g <> tags THEN g ELSE tags END AS tags,
 CASE WHEN n IS NOT NULL AND n <> note THEN n ELSE 'incoming' END AS note FROM clips c LEFT JOIN ed USING (id)""",
    "j10_reconcile_library": """WITH i AS (SELECT source || '/' || doc_id AS path, doc_id AS id, lang AS title, [lang, source] AS tags FROM documents WHERE lang <> 'es'),
f AS (SELECT source || '/' || doc_id AS path, CASE WHEN n_chars < 700 THEN -1 ELSE doc_id END AS id, CASE WHEN n_chars < 1500 THEN 'renamed' ELSE lang END AS title,
 CASE WHEN n_chars > 5000 THEN [source, lang] ELSE [lang, source] END AS tags FROM documents WHERE n_chars > 500)
SELECT coalesce(i.path, f.path) AS path, coalesce(i.id, f.id) AS id, CASE WHEN f.path IS NULL THEN 'missing' WHEN i.path IS NULL THEN 'orphan' WHEN i.id <> f.id THEN 'replaced'
 WHEN i.title <> f.title OR i.tags <> f.tags THEN 'stale' ELSE 'ok' END AS status FROM i FULL JOIN f ON i.path = f.path""",
}
