from __future__ import annotations

from gleanery.derive import BRAND_TYPE, TYPE_KIND, TYPE_SUFFIX
from gleanery.oracle.plain import plain
from gleanery.oracle.pages import LINKS as PAGE_LINKS, WS, canonical


def case(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


ITEMS = f"""items0 AS (SELECT p_partkey AS id, {case('p_type', TYPE_KIND, 'image')} AS kind, {case('p_brand', BRAND_TYPE, '')} AS content_type,
  CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN p_name || '.pdf' WHEN p_size < 30 THEN p_name || '.jpeg' ELSE p_name || '.1706' END AS file_name,
  'https://cdn.example.com/f/' || replace(p_name, ' ', '-') || {case('p_type', TYPE_SUFFIX, '')} AS url, p_size,
  CASE WHEN p_size <= 45 THEN p_size::BIGINT * 4 * 1048576 END AS bytes FROM part),
items AS (SELECT *, CASE WHEN p_size < 5 THEN url ELSE 'https://site.example.org/p/' || id END AS page_url,
  lower(trim(split_part(content_type, ';', 1))) AS mime, lower(regexp_extract(regexp_replace(url, '\\?.*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS usuf,
  CASE WHEN p_size BETWEEN 10 AND 19 THEN 'pdf' WHEN p_size BETWEEN 20 AND 29 THEN 'jpeg' ELSE '' END AS nsuf FROM items0)"""
TYPE_KIND_SQL = "CASE WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'video/%' THEN 'video' END"

LINKS = """plinks0 AS (SELECT page_id, url, md5(url) AS h, page_id::VARCHAR AS n FROM pages),
plinks1 AS (SELECT page_id, [url, 'https://youtu.be/' || h[1:11] || '?t=3', 'http://m.youtube.com/watch?list=x&v=' || h[1:11],
 'https://www.youtube.com/shorts/' || h[1:10], 'https://www.bilibili.com/video/BV' || h[1:10] || '?p=' || n, 'https://m.bilibili.com/video/av' || n || '/',
 'https://www.bilibili.com/bangumi/play/ep' || n, 'https://b23.tv/' || h[1:7], 'https://twitter.com/u' || n || '/status/' || n || '/video/1?s=2',
 'https://x.com/u' || n || '/status/' || n, 'https://pan.baidu.com/s/1' || h[1:8] || '?pwd=ab12',
 'https://pan.baidu.com/share/init?surl=' || h[1:8] || '&pwd=a%20b', 'https://115.com/s/' || h[1:8] || '?password=x#top', 'https://pan.quark.cn/s/' || h[1:8]] AS a FROM plinks0),
plinks AS (SELECT page_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS url FROM plinks1),
streams0 AS (SELECT *,
 CASE WHEN regexp_matches(url, '^https?://(youtu\\.be/|(m|www|music)\\.youtube\\.com/(watch|shorts/|live/|embed/))') THEN 'youtube'
      WHEN regexp_matches(url, '^https?://((m|www)\\.bilibili\\.com/|b23\\.tv/)') THEN 'bilibili'
      WHEN regexp_matches(url, '^https?://(x|twitter)\\.com/\\w+/status/\\d+/video/\\d+') THEN 'x'
      WHEN regexp_matches(url, '^https?://pan\\.baidu\\.com/') THEN 'baidupan'
      WHEN regexp_matches(url, '^https?://115\\.com/s/') THEN '115'
      WHEN regexp_matches(url, '^https?://pan\\.quark\\.cn/s/') THEN 'quark' END AS platform,
 coalesce(nullif(regexp_extract(url, '(?:youtu\\.be/|v=|shorts/|/video/|/play/|/status/|baidu\\.com/s/1|surl=|115\\.com/s/|quark\\.cn/s/)([A-Za-z0-9_-]+)', 1), ''), '') AS video_id,
 nullif(regexp_extract(url, '\\?p=(\\d+)', 1), '')::INT AS p FROM plinks),
streams1 AS (SELECT * FROM streams0 WHERE platform IS NOT NULL AND NOT (platform = 'youtube' AND length(video_id) <> 11)),
streams AS (SELECT page_id, pos, url, platform, video_id,
 CASE platform WHEN 'youtube' THEN 'https://www.youtube.com/watch?v=' || video_id
  WHEN 'bilibili' THEN CASE WHEN video_id = '' THEN url WHEN starts_with(video_id, 'ep') THEN 'https://www.bilibili.com/bangumi/play/' || video_id
     ELSE 'https://www.bilibili.com/video/' || video_id || CASE WHEN p > 1 THEN '?p=' || p ELSE '' END END
  WHEN 'x' THEN 'https://x.com/' || regexp_extract(url, '\\.com/([^?]*)', 1)
  WHEN 'baidupan' THEN 'https://pan.baidu.com/s/1' || video_id || '?pwd=' || regexp_extract(url, 'pwd=(.*)$', 1)
  WHEN '115' THEN 'https://115cdn.com/s/' || video_id || '?password=x' ELSE 'https://pan.quark.cn/s/' || video_id END AS canonical,
 CASE WHEN platform = 'youtube' THEN 'https://www.youtube.com/embed/' || video_id
  WHEN platform = 'bilibili' AND starts_with(video_id, 'BV') THEN 'https://player.bilibili.com/player.html?bvid=' || video_id || CASE WHEN p > 1 THEN '&page=' || p ELSE '' END
  WHEN platform = 'bilibili' AND starts_with(video_id, 'av') THEN 'https://player.bilibili.com/player.html?aid=' || video_id[3:]
  ELSE '' END AS embed FROM streams1)"""

DOCS = """idocs0 AS (SELECT page_id AS doc_id, regexp_extract(url, '^https?://[^/?#]*') AS origin, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS words FROM pages),
refs AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(list_transform(words, lambda w: origin || '/' || w || '.png')) AS url FROM idocs0
 UNION ALL SELECT doc_id, len(words), origin || '/x' || repeat('(', 20) || doc_id || repeat(')', 20) || '.png' FROM idocs0),
plan0 AS (SELECT doc_id, url, min(pos) AS pos FROM refs GROUP BY 1, 2),
plan AS (SELECT doc_id, url, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS index FROM plan0 QUALIFY index <= 100)"""

def j(x: str) -> str:
    return f"to_json({x})::VARCHAR"


SQL = {
    "p5_classify_captures": """WITH e AS (SELECT event_id AS id, value AS v, regexp_extract(props, '"k": *(\\d+)', 1)::INT AS k,
  CASE event_type WHEN 'click' THEN 'link' WHEN 'signup' THEN 'media' WHEN 'error' THEN 'quote' WHEN 'purchase' THEN 'stream' ELSE 'page' END AS kind FROM events)
SELECT id, kind, CASE WHEN kind IN ('quote', 'media', 'stream') AND v > 3 THEN kind WHEN kind = 'page' AND v > 1 AND k < 50 THEN 'x' WHEN kind = 'page' AND v > 1 THEN 'web' ELSE 'link' END AS medium,
 CASE WHEN kind IN ('quote', 'media', 'stream') AND v > 3 THEN 'full' WHEN kind = 'page' AND v > 1 THEN CASE WHEN k < 20 THEN 'partial' ELSE 'full' END
  WHEN kind = 'link' THEN CASE WHEN v > 5 THEN 'full' ELSE 'partial' END ELSE 'fallback' END AS extract FROM e""",
    "p6_route_pages": f"""WITH {LINKS} SELECT l.page_id * 100 + l.pos AS id,
 CASE WHEN s.platform IS NOT NULL THEN 'stream' WHEN l.pos = 0 THEN 'media' ELSE 'page' END AS action, s.platform AS platform,
 CASE WHEN s.platform IS NULL AND l.pos = 0 THEN 'pdf' END AS kind FROM plinks l LEFT JOIN streams s ON l.page_id = s.page_id AND l.pos = s.pos""",
    "p6_route_items": f"""WITH {LINKS}, i AS (SELECT l.*, s.platform, s.video_id,
  CASE WHEN l.page_id < l.pos * 20 THEN 'image' WHEN l.pos < 5 THEN 'audio' ELSE 'video' END AS kind,
  CASE WHEN length(l.url) < 45 THEN l.url WHEN length(l.url) < 50 THEN 'blob:x' ELSE '' END AS src FROM plinks l LEFT JOIN streams s ON l.page_id = s.page_id AND l.pos = s.pos),
a AS (SELECT *, CASE WHEN kind <> 'image' AND platform = 'x' THEN 'x-video' WHEN kind <> 'image' THEN 'stream'
  WHEN starts_with(src, 'http') THEN 'media' ELSE 'fail' END AS action FROM i)
SELECT page_id * 100 + pos AS id, action, CASE WHEN action = 'x-video' THEN video_id WHEN action = 'stream' THEN coalesce(video_id, md5(url)[1:11]) END AS target FROM a""",
    "p7_stream_links": f"WITH {LINKS} SELECT page_id, pos, platform, video_id, canonical, embed FROM streams",
    "p9_direct_or_stream": f"""WITH {ITEMS}, t AS (SELECT *, coalesce({TYPE_KIND_SQL}, kind) AS typed, coalesce(bytes > 104857600, false) AS large FROM items),
o AS (SELECT *, CASE WHEN kind IN ('audio', 'video') AND ((typed IN ('audio', 'video') AND bytes IS NULL) OR large) THEN 'stream' WHEN large THEN 'bookmark' ELSE 'media' END AS outcome FROM t)
SELECT id, outcome, CASE WHEN outcome = 'stream' AND page_url <> url THEN page_url END AS stream_page FROM o""",
    "j3_media_kinds": f"""WITH {ITEMS}
SELECT id, coalesce({TYPE_KIND_SQL}, CASE WHEN mime IN ('', 'application/octet-stream', 'application/zip') AND file_name = '' AND usuf = 'epub' THEN 'epub' END,
  CASE usuf WHEN 'jpeg' THEN 'image' WHEN 'svg' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'epub' THEN 'epub' WHEN 'flac' THEN 'audio' END) AS kind,
 coalesce(CASE mime WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'video/mp4' THEN 'mp4' WHEN 'audio/mpeg' THEN 'mp3' WHEN 'application/pdf' THEN 'pdf' WHEN 'image/svg+xml' THEN 'svg' END,
  CASE coalesce(nullif(nsuf, ''), usuf) WHEN 'jpeg' THEN 'jpg' WHEN 'pdf' THEN 'pdf' WHEN 'mp4' THEN 'mp4' WHEN 'epub' THEN 'epub' WHEN 'flac' THEN 'flac' END, 'bin') AS ext FROM items""",
    "j3_header_names": f"""WITH {ITEMS},
h AS (SELECT *, CASE id % 6 WHEN 0 THEN 'part ' || id || ' "x".jpeg' WHEN 1 THEN 'part ' || id || '.PDF' WHEN 2 THEN 'dé ' || id || '.epub' WHEN 3 THEN '100%25%ZZ' || id || '.flac' ELSE '' END AS name,
  CASE id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'pdf' WHEN 2 THEN 'epub' WHEN 3 THEN 'flac' ELSE nsuf END AS hsuf FROM items)
SELECT id, name, coalesce({TYPE_KIND_SQL}, CASE WHEN mime IN ('', 'application/octet-stream', 'application/zip') AND (hsuf = 'epub' OR name = '' AND file_name = '' AND usuf = 'epub') THEN 'epub' END,
  CASE usuf WHEN 'jpeg' THEN 'image' WHEN 'svg' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'epub' THEN 'epub' WHEN 'flac' THEN 'audio' END) AS kind,
 coalesce(CASE mime WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'video/mp4' THEN 'mp4' WHEN 'audio/mpeg' THEN 'mp3' WHEN 'application/pdf' THEN 'pdf' WHEN 'image/svg+xml' THEN 'svg' END,
  CASE coalesce(nullif(hsuf, ''), usuf) WHEN 'jpeg' THEN 'jpg' WHEN 'pdf' THEN 'pdf' WHEN 'mp4' THEN 'mp4' WHEN 'epub' THEN 'epub' WHEN 'flac' THEN 'flac' END, 'bin') AS ext FROM h""",
    "j4_image_types": f"""WITH {ITEMS} SELECT id, CASE WHEN mime = 'image/jpeg' THEN 'jpg' WHEN mime = 'image/png' THEN 'png' WHEN mime = 'image/svg+xml' THEN 'svg'
  WHEN mime LIKE 'text/%' OR mime = 'application/json' THEN NULL WHEN usuf = 'jpeg' THEN 'jpg' END AS ext FROM items""",
    "j5_same_site_links": f"""WITH {PAGE_LINKS}, p AS (SELECT l.page_id, a.url AS page_url, l.url FROM links l JOIN pages a USING (page_id)
  UNION ALL SELECT a.page_id, a.url, b.url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1),
h AS (SELECT *, regexp_extract(page_url, '^(https?)', 1) = regexp_extract(url, '^(https?)', 1) AS scheme,
  regexp_extract(page_url, '^https?://([^/?#]*)', 1) AS a, regexp_extract(url, '^https?://([^/?#]*)', 1) AS b FROM p),
s AS (SELECT page_id, url, scheme AND (a = b OR regexp_extract(a, '[^.]+\\.[^.]+$') = regexp_extract(b, '[^.]+\\.[^.]+$')) AS same_site FROM h)
SELECT page_id, url, same_site, CASE WHEN same_site THEN 'include' ELSE 'omit' END AS credentials FROM s""",
    "a7_distinct_media": f"""WITH t AS (SELECT page_id AS id, {canonical('url')} AS k1, 'data:sha256:' || sha256(html) AS k2 FROM pages),
k AS (SELECT id, k1 AS key FROM t UNION ALL SELECT id, k2 FROM t UNION ALL SELECT id, k2 FROM t)
SELECT key, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1""",
    "w2_plan_images": f"WITH {DOCS} SELECT doc_id, url, index FROM plan",
    "j7_rewrite_images": f"""WITH {DOCS},
r AS (SELECT r.doc_id, r.pos, r.url, regexp_extract(r.url, '/([^/]*)\\.png$', 1) AS word,
  CASE WHEN length(r.url) % 2 = 0 AND p.index IS NOT NULL THEN '.assets/' || r.doc_id || '/' || p.index || '.png' ELSE r.url END AS target FROM refs r LEFT JOIN plan p ON r.doc_id = p.doc_id AND r.url = p.url),
b AS (SELECT doc_id, string_agg('![' || word || '](' || target || ') text', chr(10) ORDER BY pos) FILTER (WHERE url NOT LIKE '%((((%') AS lines, max(target) FILTER (WHERE url LIKE '%((((%') AS deep FROM r GROUP BY 1)
SELECT i.doc_id, '```' || chr(10) || '![in fence](https://a.example/fence.png)' || chr(10) || '```' || chr(10) || chr(10) || coalesce(b.lines, '') || chr(10) || chr(10) ||
 '`![in code](https://a.example/code.png)` \\![escaped](https://a.example/esc.png) ![data](data:image/png;base64,AA)' || chr(10) || '![' || repeat('[', 20) || 'deep' || repeat(']', 20) || '](' || b.deep || ')' || chr(10) AS body FROM idocs0 i LEFT JOIN b ON i.doc_id = b.doc_id""",
    "a4_image_stats": "SELECT l_orderkey AS id, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS image_count, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS image_failures FROM lineitem GROUP BY 1",
    "w7_admit_by_budget": """WITH RECURSIVE i AS (SELECT l_orderkey AS record, l_linenumber::BIGINT * 1000000000 + l_partkey AS pos, l_quantity AS size,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem),
g AS (SELECT record, rn, pos, size, size <= 45 AND size <= 100 AS ok, CASE WHEN size <= 45 THEN 100 - size ELSE 100.0 END AS rest FROM i WHERE rn = 1
 UNION ALL SELECT i.record, i.rn, i.pos, i.size, i.size <= 45 AND g.rest > 0 AND i.size <= g.rest, CASE WHEN i.size <= 45 AND i.size <= g.rest THEN g.rest - i.size ELSE g.rest END
 FROM g JOIN i ON i.record = g.record AND i.rn = g.rn + 1)
SELECT record, pos, size, ok AS admitted FROM g""",
    "w7_admit_long_records": """WITH RECURSIVE i AS (SELECT l_suppkey % 3 AS record, l_orderkey * 10 + l_linenumber AS pos, max((l_partkey * 37 + l_orderkey) % 1000)::BIGINT AS tenths FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY pos) AS rn FROM i),
g AS (SELECT DISTINCT record, 0::BIGINT AS rn, NULL::BIGINT AS pos, 0::BIGINT AS tenths, false AS ok, 250007::BIGINT AS rest FROM n
 UNION ALL SELECT n.record, n.rn, n.pos, n.tenths, n.tenths <= 975 AND g.rest > 0 AND n.tenths <= g.rest, CASE WHEN n.tenths <= 975 AND n.tenths <= g.rest THEN g.rest - n.tenths ELSE g.rest END
 FROM g JOIN n ON n.record = g.record AND n.rn = g.rn + 1)
SELECT record, pos, tenths / 10.0 AS size, ok AS admitted FROM g WHERE rn > 0""",
    "p10_clip_documents": f"""WITH d AS (SELECT doc_id::VARCHAR AS id, 'https://www.' || source || '.example.com/a(' || doc_id || ')' AS src, 'https://www.' || source || '.example.com/a%28' || doc_id || '%29' AS link,
  CASE lang WHEN 'en' THEN 'web' WHEN 'de' THEN 'link' WHEN 'fr' THEN 'video' ELSE 'quote' END AS medium, split_part(text, chr(10), 1) AS title, source, lang, text, n_chars,
  strftime(make_timestamp((1704067200 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS captured FROM documents),
h AS (SELECT *, concat_ws(chr(10), '---', 'id: ' || {j('id')}, 'source: ' || {j('src')}, 'medium: ' || {j('medium')}, 'title: ' || {j('title')},
  'author: ' || {j('source')}, 'published: ""', 'captured: "' || captured || '"', 'site: ' || {j("source || '.example.com'")}, 'tags: [' || {j('lang')} || ', ' || {j('source')} || ']', 'note: ""',
  'extract: ' || CASE WHEN lang = 'de' THEN '"fallback"' ELSE '"full"' END ||
  CASE WHEN lang = 'fr' THEN chr(10) || concat_ws(chr(10), 'platform: "youtube"', 'video_id: ""', 'embed: ""', 'duration: ' || n_chars, 'cover: ""') ELSE '' END, '---') || chr(10) || chr(10) AS head,
  trim(regexp_replace(title, '{WS}+', ' ', 'g')) AS line, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS trimmed FROM d)
SELECT id, CASE medium
 WHEN 'web' THEN rtrim(head || concat_ws(chr(10) || chr(10), '# ' || line, '[Source](' || link || ')', nullif(trimmed, '')), E' \\n\\t\\r') || chr(10)
 WHEN 'link' THEN rtrim(head || concat_ws(chr(10) || chr(10), '[' || regexp_replace(line, '([\\\\\\[\\]])', '\\\\\\1', 'g') || '](' || link || ')', nullif(trimmed, '')), E' \\n\\t\\r') || chr(10)
 WHEN 'video' THEN rtrim(head || concat_ws(chr(10) || chr(10), '# ' || line, '[Source](' || link || ')', '▶ YouTube video (' ||
   CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ':' || lpad((n_chars % 3600 // 60)::VARCHAR, 2, '0') ELSE (n_chars // 60)::VARCHAR END || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') || ') · ' || source, nullif(trimmed, '')), E' \\n\\t\\r') || chr(10)
 ELSE head || concat_ws(chr(10) || chr(10), '# Quotes - ' || line, '[Source](' || link || ')', text) || chr(10) END AS document FROM h""",
    "p11_plain_text": f"""WITH s AS (SELECT doc_id, {plain('text')} AS text FROM documents)
SELECT doc_id, text, length(text) AS length FROM s""",
    "x1_chunk_documents": r"""WITH RECURSIVE s0 AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+\z') AS ss FROM documents WHERE length(text) > 2000),
s1 AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM s0),
s2 AS (SELECT doc_id, i, k, CASE WHEN length(s) > 2000 THEN s[k * 2000 + 1 : (k + 1) * 2000] ELSE s END AS u FROM s1, unnest(range(0, ((length(s) + 1999) // 2000)::BIGINT)) AS t(k)),
u AS (SELECT doc_id, u, length(u) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS rn FROM s2),
g AS (SELECT doc_id, rn, n AS open, 0 AS chunk_no FROM u WHERE rn = 1
 UNION ALL SELECT u.doc_id, u.rn, CASE WHEN g.open + u.n <= 2000 THEN g.open + u.n ELSE u.n END, CASE WHEN g.open + u.n <= 2000 THEN g.chunk_no ELSE g.chunk_no + 1 END
 FROM g JOIN u ON u.doc_id = g.doc_id AND u.rn = g.rn + 1)
SELECT g.doc_id, g.chunk_no, string_agg(u.u, '' ORDER BY u.rn) AS text FROM g JOIN u ON g.doc_id = u.doc_id AND g.rn = u.rn GROUP BY 1, 2
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 2000""",
}
SQL["x2_join_chunks"] = (
    SQL["x1_chunk_documents"].replace("SELECT g.doc_id, g.chunk_no, string_agg", ", c AS (SELECT g.doc_id, g.chunk_no, string_agg", 1)
    + rf"), t AS (SELECT doc_id, chunk_no, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t FROM c)"
    + " SELECT doc_id, CASE WHEN lang = 'de' THEN string_agg(t, '' ORDER BY chunk_no) ELSE string_agg(t, ' ' ORDER BY chunk_no) END AS text FROM t JOIN documents USING (doc_id) GROUP BY doc_id, lang"
)
