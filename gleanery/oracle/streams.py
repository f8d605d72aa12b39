from __future__ import annotations

from gleanery.oracle.media import ITEMS, SQL as MEDIA
from gleanery.oracle.pages import WS
from gleanery.oracle.stores import SAVES

DOC = MEDIA["p10_clip_documents"]
STORED = """SELECT doc_id::VARCHAR AS id, CASE lang WHEN 'en' THEN 'web' WHEN 'de' THEN 'link' WHEN 'fr' THEN 'video' ELSE 'quote' END AS medium,
 'https://www.' || source || '.example.com/a(' || doc_id || ')' AS source, [lang, source] AS tags, split_part(text, chr(10), 1) AS title FROM documents"""
SIDE = f"""{ITEMS}, side AS (SELECT id::VARCHAR AS id, file_name AS file, page_url AS source, url AS media_url, kind AS medium, 'Title' AS title, 'cdn.example.com' AS site,
 '2024-01-01T00:00:00.000Z' AS captured, coalesce(bytes, 0) AS bytes, content_type AS mime, [kind] AS tags, '' AS note FROM items)"""
CTRL = """e AS (SELECT user_id AS key, event_id AS id, ts, CASE event_type WHEN 'purchase' THEN 'grant' WHEN 'error' THEN 'revoke' ELSE 'push' END AS kind FROM events),
c AS (SELECT *, last_value(CASE WHEN kind <> 'push' THEN kind END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state,
  min(CASE WHEN kind = 'grant' THEN ts END) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_grant FROM e)"""

SQL = {
    "w8_clean_names": f"""WITH n AS (SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(text, '[/\\\\:*?"<>|\\p{{Cc}}]', '-', 'g'), '{WS}+', ' ', 'g')), '^\\.+ *', '') AS n FROM documents)
SELECT doc_id, CASE WHEN n = '' THEN 'Untitled' WHEN length(n) > 60 THEN left(n, 59) || '…' ELSE n END AS base FROM n""",
    "w8_unique_names": """WITH t AS (SELECT DISTINCT p_name FROM part WHERE p_size = 1),
r AS (SELECT p_partkey AS id, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) + CASE WHEN p_name IN (SELECT p_name FROM t) THEN 1 ELSE 0 END AS n FROM part)
SELECT id, p_name || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.md' AS file FROM r""",
    "w8_contested_names": """WITH RECURSIVE x AS (SELECT event_id AS id, 'f' || user_id % 40 AS family, 'f' || user_id % 40 || CASE WHEN event_type IN ('purchase', 'click') THEN ' (' || 2 + event_id * 7 % 90 || ')' ELSE '' END AS base, event_id FROM events),
t AS (SELECT 'f' || user_id % 40 AS family, list(DISTINCT 'f' || user_id % 40 || ' (' || 3 + event_id % 60 || ')') AS taken FROM events WHERE event_id % 50 = 0 GROUP BY 1),
c AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY id) AS rn FROM x),
g AS (SELECT DISTINCT c.family, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS name, coalesce(t.taken, []) AS taken FROM c LEFT JOIN t USING (family)
 UNION ALL SELECT family, rn, id, name, list_append(taken, name) FROM (SELECT c.family, c.rn, c.id, g.taken,
   list_filter(list_transform(range(1, len(g.taken) + 2), lambda n: c.base || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END), lambda x: NOT list_contains(g.taken, x))[1] AS name
   FROM g JOIN c ON c.family = g.family AND c.rn = g.rn + 1))
SELECT id, name || '.md' AS file FROM g WHERE rn > 0""",
    "s4_write_clips": f"WITH doc AS ({DOC}), s AS ({STORED}) SELECT s.id, s.medium, document, s.source, s.tags, CASE WHEN text <> '' THEN '1.txt' END AS attached, CASE WHEN text <> '' THEN sha256(text) END AS sha256 FROM doc JOIN s USING (id) JOIN documents ON id = doc_id::VARCHAR",
    "s5_sidecar_json": f"WITH {SIDE} SELECT id, to_json(side)::VARCHAR AS value FROM side",
    "s3_read_sidecars": f"WITH {SIDE} SELECT * FROM side",
    "s2_read_clip_library": f"""WITH doc AS ({DOC}), s AS ({STORED})
SELECT id || '.md' AS path, id, title, tags, '' AS note, regexp_replace(document, '^---\\n(?s:.*?)\\n---\\n', '') AS body FROM doc JOIN s USING (id)""",
    "s6_stream_captures": "SELECT page_id, url, html, 'page' AS kind FROM pages",
    "st1_stream_once": "SELECT DISTINCT ON (event_id) event_id AS op_id, ts, event_type FROM events",
    "st2_stream_saved_index": f"""WITH {SAVES} SELECT source, ts AS saved_at, id, event_type AS title FROM saves
QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) = 1""",
    "st3_stream_threads": """WITH g AS (SELECT user_id AS key, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(o) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
a AS (SELECT key, min(ts) AS opened, max(ts) + INTERVAL 6 HOUR AS closed, count(*) AS n, max(ts) - min(ts) >= INTERVAL 10 HOUR AS timeout FROM s GROUP BY key, s.n)
SELECT key, opened, closed, n, n > 3 AS "limit", timeout, n > 3 OR timeout AS partial FROM a""",
    "st4_stream_pending_queue": f"""WITH {CTRL},
q AS (SELECT key, id, ts AS queued_at, next_grant AS saved_at, row_number() OVER (PARTITION BY key, next_grant ORDER BY ts DESC, id DESC) AS rn FROM c WHERE kind = 'push' AND coalesce(state, 'revoke') = 'revoke' AND next_grant IS NOT NULL)
SELECT key, id, queued_at, saved_at FROM q WHERE rn <= 20 UNION ALL SELECT key, id, ts, ts FROM c WHERE kind = 'push' AND state = 'grant'""",
    "st6_stream_batches": """WITH w AS (SELECT user_id AS key, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS opened, count(*) AS units, max(ts) AS last_ts FROM events GROUP BY 1, 2)
SELECT * FROM w""",
    "st7_stream_take": """WITH r AS (SELECT user_id AS key, ts, event_id AS id FROM events WHERE event_type = 'click'), o AS (SELECT user_id AS key, ts, event_id AS id FROM events WHERE event_type = 'view'),
p AS (SELECT r.key, r.id AS request_id, r.ts AS asked, o.id AS open_id, o.ts AS opened FROM r JOIN o ON r.key = o.key AND o.ts BETWEEN r.ts AND r.ts + INTERVAL 7200 SECOND),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key, request_id ORDER BY opened, open_id) = 1)
SELECT key, open_id, request_id FROM f QUALIFY row_number() OVER (PARTITION BY key, open_id ORDER BY asked DESC, request_id DESC) = 1""",
    "st8_stream_generation_guard": """WITH u AS (SELECT user_id AS key, event_id AS id, ts, day(ts) - CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS generation FROM events)
SELECT * FROM u QUALIFY generation >= max(generation) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""",
    "st5_stream_throttle": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS now, CASE event_type WHEN 'purchase' THEN 'finished' ELSE 'running' END AS phase,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT key, rn, now, now AS last, phase, NULL::BIGINT AS wid, NULL::BIGINT AS wdue, NULL::BIGINT AS fid, NULL::BIGINT AS fat, id AS sid FROM e WHERE rn = 1
 UNION ALL SELECT key, rn, now, CASE WHEN send THEN now ELSE last1 END, CASE WHEN send THEN phase ELSE before END, CASE WHEN send THEN NULL ELSE id END, CASE WHEN send THEN NULL ELSE last1 + 21600000 END,
  fid, fat, CASE WHEN send THEN id END
 FROM (SELECT *, phase <> before OR phase = 'finished' OR now - last1 >= 21600000 AS send
  FROM (SELECT e.key, e.rn, e.now, e.id, e.phase, r.phase AS before, CASE WHEN r.wdue <= e.now THEN r.wdue ELSE r.last END AS last1,
    CASE WHEN r.wdue <= e.now THEN r.wid END AS fid, CASE WHEN r.wdue <= e.now THEN r.wdue END AS fat FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)))
SELECT key, fid AS id, fat AS sent_at_ms FROM r WHERE fid IS NOT NULL UNION ALL SELECT key, sid, now FROM r WHERE sid IS NOT NULL
UNION ALL SELECT key, wid, wdue FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1) WHERE wid IS NOT NULL""",
}

# the edited document is the one that would be built from the edited values,
# but for quotes, whose shown title is not the plain one
_EDITED = DOC
for _old, _new in (
    ("split_part(text, chr(10), 1) AS title", "'New [' || doc_id || ']  title' AS title, split_part(text, chr(10), 1) AS old"),
    ("trim(regexp_replace(title, ", "trim(regexp_replace(CASE WHEN medium = 'quote' THEN old ELSE title END, "),
    ("'note: \"\"'", "'note: \"n\"'"),
):
    assert _old in _EDITED, _old
    _EDITED = _EDITED.replace(_old, _new)
_TAGS = _EDITED.index("'tags: ['")
_EDITED = _EDITED[:_TAGS] + "'tags: [\"t\", \"q\\\"\"]'" + _EDITED[_EDITED.index(", 'note:", _TAGS) :]
SQL["j8_edit_documents"] = _EDITED
SQL["a5_translation_fields"] = f"""WITH doc AS ({DOC}) SELECT id, CASE WHEN length(text) >= 3000 THEN document
 ELSE regexp_replace(document, '(?m)^(extract: .*)$', '\\1' || chr(10) || 'lang: "' || lang || '"' || chr(10) || 'translated_to: "zh-Hant"' || chr(10) || 'translation: "' || CASE WHEN length(text) < 1000 THEN 'partial' ELSE 'complete' END || '"') END AS document
FROM doc JOIN documents ON id = doc_id::VARCHAR"""
