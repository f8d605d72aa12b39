from __future__ import annotations

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

MACROS = rf"""
  ws_collapse(s) AS trim(regexp_replace(s, '{WS}+', ' ', 'g'))
"""


def collapse(s: str) -> str:
    return f"trim(regexp_replace({s}, '{WS}+', ' ', 'g'))"


def entities(s: str) -> str:
    """Enough for the tables, whose pages hold only these four by name."""
    return f"replace(replace(replace(replace({s}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def canonical(u: str) -> str:
    """Key of the addresses in the tables (http/https, ASCII, no user info)."""
    base = f"regexp_replace({u}, '#.*$', '')"
    path = f"regexp_replace({base}, '\\?.*$', '')"
    query = f"regexp_extract({base}, '\\?(.*)$', 1)"
    kept = (
        f"array_to_string(list_filter(string_split({query}, '&'), lambda s: s <> '' AND NOT starts_with(lower(s), 'utm_')"
        " AND NOT list_contains(['fbclid','gclid','dclid','msclkid','igshid','mc_cid','mc_eid','ref_src','spm','si'],"
        " lower(split_part(s, '=', 1)))), '&')"
    )
    return f"{path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


SITE = "regexp_replace(regexp_extract(source, '^https?://([^/?#]*)', 1), '^www\\.', '')"
CLEAN = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>', '', 'g')"
ARTICLE_TEXT = collapse(entities(rf"regexp_replace(regexp_extract({CLEAN}, '(?is)<article\b[^>]*>(.*)</article>', 1), '<[^>]*>', '', 'g')"))
TITLE = collapse(entities(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)"))

# pages as links: every anchor of the tables is rooted ('/word')
LINKS = rf"""
links0 AS (SELECT page_id, url AS page_url, regexp_extract_all({CLEAN}, '<(?:a|img)\b[^>]*>') AS tags FROM pages),
links1 AS (SELECT page_id, page_url, unnest(range(len(tags))) AS pos, unnest(tags) AS markup FROM links0),
links2 AS (SELECT page_id, pos, 'a' AS tag, regexp_extract(page_url, '^https?://[^/?#]*') AS origin,
                  regexp_extract(markup, 'href="([^"]*)"', 1) AS href FROM links1),
links AS (SELECT page_id, pos, tag, origin || array_to_string(list_transform(
              regexp_extract_all(href, '[\x00-\x7F]+|[^\x00-\x7F]+'),
              lambda p: CASE WHEN regexp_matches(p, '[^\x00-\x7F]') THEN url_encode(p) ELSE p END), '') AS url FROM links2)
"""

SQL = {
    "flagship_site_report": f"""
WITH n AS (SELECT page_id, {canonical('url')} AS source, length({TITLE}) AS title_length, length({ARTICLE_TEXT}) AS text_length FROM pages),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_id DESC) = 1)
SELECT {SITE} AS site, count(*) AS pages, sum(CASE WHEN text_length >= 200 THEN 1 ELSE 0 END) AS full_pages,
       sum(CASE WHEN text_length >= 200 THEN 0 ELSE 1 END) AS fallback_pages, sum(text_length) AS text_chars, max(title_length) AS longest_title
FROM l GROUP BY 1""",
    "s1_read_captures": "SELECT page_id, url, html, 'page' AS kind, '' AS title, NULL::VARCHAR AS markdown FROM pages",
    "p1_canonical_sources": f"WITH k AS (SELECT page_id, {canonical('url')} AS source FROM pages) SELECT page_id, source, {SITE} AS site FROM k",
    "p1_any_scheme": """WITH p AS (SELECT page_id, page_id::VARCHAR AS n, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, unnest(range(9))::INT AS pos, unnest(['ftp://U@' || lower(host) || path || '/%C3%A9?k=' || n, 'wss://' || lower(host) || ':444/?q=%27', 'file://' || path || '/b%20c.txt',
  'file://' || CASE WHEN path = '' THEN '/' ELSE path END, 'mailto:Some One@' || upper(host) || '?subject=a%20b&cc=' || n, 'app+x://' || upper(host) || ':80' || path || '/y?a=' || chr(39) || '1' || chr(39),
  'app://' || upper(host), 'app://bad host/' || n, 'tel:+' || n]) AS source FROM p""",
    "j1_index_keys": f"""WITH p AS (SELECT page_id, {canonical('url')} AS key FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'quote' WHEN 1 THEN 'media' ELSE 'page' END AS kind, CASE page_id % 3 WHEN 0 THEN 'quote:' || key
 WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN key ELSE 'data:sha256:' || sha256(page_id || ' x') END ELSE key END AS key FROM p""",
    "p2_page_meta": f"SELECT page_id, {TITLE} AS title, '' AS description, '' AS image, '' AS site_name, '' AS published, '' AS author FROM pages",
    "p2_page_meta_tags": """SELECT page_id, 'First & ' || trim(regexp_extract(html, '<a href="/([^"]*)">', 1)) AS title, 'plain text <b>' AS description,
 regexp_extract(url, '^https?://[^/?#]*') || '/i/' || page_id || '.png?a=1&b=2' AS image, '' AS site_name, '2024-01-02' AS published, 'Me' AS author FROM pages""",
    "p3_page_links": f"WITH {LINKS} SELECT page_id, pos, tag, url FROM links",
    "p4_text_gate": f"""WITH t AS (SELECT page_id, length({ARTICLE_TEXT}) AS text_length FROM pages)
SELECT page_id, text_length, CASE WHEN text_length >= 200 THEN 'full' ELSE 'fallback' END AS extract FROM t""",
}
