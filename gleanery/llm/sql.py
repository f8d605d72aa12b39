"""SQL twins of the operators that SQL expresses."""

SQL: dict[str, str] = {}

SQL["op3_warc"] = """
WITH f AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM g
"""

SQL["op5_extendible_shards"] = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
    ('0x' || substr(md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 14))::BIGINT AS h FROM documents),
e AS (SELECT d.*, x.depth, h >> (56 - x.depth) AS prefix FROM d, (SELECT unnest(range(0, 57))::INT AS depth) x),
b AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM e GROUP BY ALL
    HAVING sum(n_bytes) <= 4194304 OR min(h) = max(h)),
l AS (SELECT e.doc_id, e.n_bytes, e.h, b.* FROM e JOIN b USING (depth, prefix)),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
  CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs, shard_bytes <= 4194304 AS fits FROM f
"""

SQL["op7_preference_pairs"] = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS odd, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
pairs AS (SELECT DISTINCT pair_id FROM t),
m AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k,
    coalesce(c.role = r.role AND c.text = r.text, false) AS same
    FROM (SELECT * FROM t WHERE odd = 0) c FULL JOIN (SELECT * FROM t WHERE odd = 1) r ON c.pair_id = r.pair_id AND c.k = r.k),
n AS (SELECT pair_id, coalesce(min(k) FILTER (WHERE NOT same) - 1, max(k)) AS common FROM m GROUP BY pair_id),
s AS (SELECT t.*, n.common, '<|' || role || '|>' || chr(10) AS head, chr(10) || '<|end|>' || chr(10) AS tail FROM t JOIN n USING (pair_id)),
w AS (SELECT *, head || text || tail AS shown, coalesce(sum(length(head || text || tail)) FILTER (WHERE k > common) OVER
    (PARTITION BY pair_id, odd ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s),
p AS (SELECT pair_id, max(common) AS common_turns,
    coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE k <= common AND odd = 0), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE k > common AND odd = 0), '') AS chosen,
    coalesce(string_agg((pos + length(head)) || '-' || (pos + length(shown)), ',' ORDER BY k) FILTER (WHERE k > common AND odd = 0 AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE k > common AND odd = 1), '') AS rejected,
    coalesce(string_agg((pos + length(head)) || '-' || (pos + length(shown)), ',' ORDER BY k) FILTER (WHERE k > common AND odd = 1 AND role = 'assistant'), '') AS rejected_mask
    FROM w GROUP BY pair_id)
SELECT pair_id, CAST(common_turns AS INT) AS common_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM p
"""

SQL["op8_content_sort"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""

SQL["op10_host_rules"] = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i + 4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1), range(0, 5) x(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(words) AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS rep, 100 * n_symbols > 100 * n_words AS sym, 100 * n_dup_lines > 50 * n_lines AS dup FROM m),
h AS (SELECT host, count(*) AS n, unnest([1, 2, 3, 4]) AS rule, unnest([count(*) FILTER (WHERE few), count(*) FILTER (WHERE rep), count(*) FILTER (WHERE sym), count(*) FILTER (WHERE dup)])::DOUBLE AS f FROM j GROUP BY host),
s AS (SELECT rule, sum(n)::DOUBLE AS n, sum(f) AS f, sum(f * f / n) AS q, count(*) AS k FROM h GROUP BY rule),
v AS (SELECT rule, n, f, f / n AS p, q / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * k / n AS between FROM s),
b AS (SELECT rule, p, CASE WHEN f = 0 OR f = n THEN 1.0 WHEN between > 1e-12 THEN least(1e6, greatest(1.0, p * (1 - p) / between - 1)) ELSE 1e6 END AS strength FROM v),
x AS (SELECT host, max(n) AS host_docs, max((f + p * strength) / (n + strength)) AS host_rate FROM h JOIN b USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, few OR rep AS base_failed, NOT (few OR rep) AND host_rate <= 0.5 AS kept,
  j.host, host_docs, host_rate FROM j JOIN x ON j.host IS NOT DISTINCT FROM x.host
"""

SQL["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM
    (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer x ON x.lang = c.lang AND x.phrase = c.phrase WHERE x.a IS NULL OR 100 * x.a < 50 * c.a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(words[1:cut], ' ') AS lp, array_to_string(words[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * cuts.a * cuts.a // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""

SQL["op12_conversation_trie"] = """
WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT *, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM own),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS h FROM crc),
r AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS t, d, turns[1:d] AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, node, node[1:d - 1] AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE t = d) AS ends,
    (count(*) - 1) * coalesce(length(node[d].text), 0) AS saved FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.node = n.node),
s AS (SELECT d, node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT x AS d, node[1:x] AS node, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM m)) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.node = m.node LEFT JOIN n up ON m.d > 0 AND up.d = m.d - 1 AND up.node = m.parent
"""
