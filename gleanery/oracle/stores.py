from __future__ import annotations

SAVES = """saves AS (SELECT event_id AS id, 'u' || user_id || '/' || regexp_extract(props, '"k": *(\\d+)', 1) AS source, ts, user_id, event_type, value FROM events)"""
INDEX = """idx AS (SELECT source, ts AS saved_at, id, event_type AS title FROM saves WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) = 1)"""
CAPTURES = """caps AS (SELECT id, source, ts, event_type = 'purchase' AS snapshot, event_type = 'error' AS quote,
  CASE WHEN value < 2 THEN 'fallback' ELSE 'full' END AS extract FROM saves WHERE event_type <> 'signup')"""
STATE = "CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'view' THEN 'fallback' WHEN 'click' THEN 'duplicate' ELSE 'failed' END"

SQL = {
    "j1_saved_lookup": f"""WITH {SAVES}, {INDEX}, {CAPTURES},
p AS (SELECT c.*, i.id AS saved_id,
   row_number() OVER w AS rn,
   last_value(CASE WHEN snapshot THEN c.id END IGNORE NULLS) OVER (PARTITION BY c.source ORDER BY c.ts, c.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS snap,
   first_value(c.id) OVER w AS first_id
   FROM caps c LEFT JOIN idx i ON c.source = i.source WHERE NOT quote WINDOW w AS (PARTITION BY c.source ORDER BY c.ts, c.id)),
q AS (SELECT *, coalesce(snap, saved_id, CASE WHEN rn > 1 THEN first_id END) AS prev FROM p)
SELECT id, source, CASE WHEN NOT snapshot AND prev IS NOT NULL THEN 'duplicate' WHEN extract = 'fallback' THEN 'fallback' ELSE 'saved' END AS state,
  CASE WHEN NOT snapshot THEN prev END AS previous_id FROM q
UNION ALL SELECT id, source, 'saved', NULL FROM caps WHERE quote""",
    "j2_new_captures": f"WITH {SAVES}, {INDEX}, {CAPTURES} SELECT id, source FROM caps WHERE NOT EXISTS (SELECT 1 FROM idx WHERE idx.source = caps.source)",
    "j2_known_captures": f"WITH {SAVES}, {INDEX}, {CAPTURES} SELECT id, source FROM caps WHERE EXISTS (SELECT 1 FROM idx WHERE idx.source = caps.source)",
    "j12_take_within_ttl": """WITH e AS (SELECT user_id AS key, ts, event_id AS id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_open
   FROM events WHERE event_type IN ('click', 'view')),
n AS (SELECT *, lead(is_open) OVER w AS nopen, lead(ts) OVER w AS nts, lead(id) OVER w AS nid FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, is_open, id)),
s AS (SELECT *, CASE WHEN nid IS NULL THEN 'waiting' WHEN nopen = 0 THEN 'overwritten' WHEN nts > ts + INTERVAL 7200 SECOND THEN 'expired' ELSE 'taken' END AS status FROM n WHERE is_open = 0)
SELECT key, id AS request_id, status, CASE WHEN status = 'taken' THEN nid END AS open_id FROM s""",
    "w1_latest_per_source": f"""WITH {SAVES}
SELECT source, ts AS saved_at, id, CASE WHEN event_type = 'error' THEN 'patched' ELSE event_type END AS title, value FROM saves
QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) = 1""",
    "w5_retain_last": f"""WITH {SAVES},
l AS (SELECT user_id, source, ts, id FROM saves QUALIFY row_number() OVER (PARTITION BY user_id, source ORDER BY ts DESC, id DESC) = 1)
SELECT user_id, source, ts, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC, source DESC) AS rank FROM l QUALIFY rank <= 20""",
    "t2_recent_clips": f"WITH {SAVES}, {INDEX} SELECT source, saved_at, id, title FROM idx ORDER BY saved_at DESC, id LIMIT 50",
    "t3_pending_head": f"WITH {SAVES} SELECT id, source, ts FROM saves WHERE event_type = 'error' ORDER BY ts, id LIMIT 5",
    "u1_locate_clips": f"""WITH {SAVES},
u AS (SELECT source AS id, ts, CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM saves WHERE event_type <> 'purchase'),
b AS (SELECT id, p, max(ts) AS saved_at FROM u GROUP BY 1, 2),
f AS (SELECT * FROM b WHERE id IN (SELECT source FROM saves WHERE value > 20) QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1)
SELECT id, CASE p WHEN 0 THEN 'recent' WHEN 1 THEN 'quotes' WHEN 2 THEN 'ops' ELSE 'index' END AS found_in, saved_at FROM f""",
    "u2_pending_minus_done": f"""SELECT user_id, event_type FROM events EXCEPT ALL
SELECT user_id, event_type FROM events WHERE value >= 5 AND {STATE} <> 'failed'""",
    "a8_outcome_counts": f"SELECT {STATE} AS state, count(*) AS n FROM events WHERE value >= 5 GROUP BY 1",
    "u3_id_overlap": """WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS wanted, regexp_extract_all(html, 'lang="([a-z]+)"', 1) AS found FROM pages)
SELECT page_id, wanted FROM p WHERE list_contains(found, wanted)""",
    "a1_tag_counts": "SELECT tag, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1",
    "a1_tag_counts_prefix": "SELECT tag, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE starts_with(tag, 's') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "t1_top_tags": "SELECT tag, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "a6_distinct_tags": """WITH t AS (SELECT p_partkey AS id, list_concat([p_type, p_brand, '', lower(p_type), p_type], string_split(p_name, ' ')) AS raw FROM part)
SELECT id, list_filter(raw, lambda x, i: x <> '' AND list_position(raw, x) = i) AS tags FROM t""",
}
