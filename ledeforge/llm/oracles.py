"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH ls AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {_LOW.format(f"trim(line, {WS})")} AS k FROM ls),
held AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.owner AS dropped FROM keyed l LEFT JOIN held h USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(trim(coalesce(text, ''), {WS}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {WS}) <> '') AS l FROM d),
s AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN ln ON d.doc_id = ln.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id),
r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         1000 * word_chars // greatest(n_words, 1) AS r1, 1000 * n_symbols // greatest(n_words, 1) AS r2,
         1000 * n_dup_lines // greatest(n_words, 1) AS r3, 1000 * n_repeat_words // greatest(n_words, 1) AS r4
  FROM s),
q AS (
  SELECT grouping(lang) + grouping(source) AS g, lang, source, count(*) AS n,
         quantile_disc(r1, 0.25) AS a1, quantile_disc(r1, 0.75) AS b1, quantile_disc(r2, 0.25) AS a2, quantile_disc(r2, 0.75) AS b2,
         quantile_disc(r3, 0.25) AS a3, quantile_disc(r3, 0.75) AS b3, quantile_disc(r4, 0.25) AS a4, quantile_disc(r4, 0.75) AS b4
  FROM r WHERE NOT base_failed GROUP BY ROLLUP (lang, source)),
f AS (
  SELECT g, lang, source, n, a1 - greatest(4 * (b1 - a1), 2000) AS lo1, b1 + greatest(4 * (b1 - a1), 3000) AS hi1,
         b2 + greatest(4 * (b2 - a2), 100) AS hi2, b3 + greatest(4 * (b3 - a3), 300) AS hi3, b4 + greatest(4 * (b4 - a4), 100) AS hi4
  FROM q WHERE n >= 20 OR g = 2),
p AS (
  SELECT r.*, coalesce(x.lo1, y.lo1, z.lo1) AS lo1, coalesce(x.hi1, y.hi1, z.hi1) AS hi1, coalesce(x.hi2, y.hi2, z.hi2) AS hi2,
         coalesce(x.hi3, y.hi3, z.hi3) AS hi3, coalesce(x.hi4, y.hi4, z.hi4) AS hi4
  FROM r LEFT JOIN (SELECT * FROM f WHERE g = 0) x ON r.lang IS NOT DISTINCT FROM x.lang AND r.source IS NOT DISTINCT FROM x.source
  LEFT JOIN (SELECT * FROM f WHERE g = 1) y ON r.lang IS NOT DISTINCT FROM y.lang
  LEFT JOIN (SELECT * FROM f WHERE g = 2) z ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(r1 >= lo1, true) AND coalesce(r1 <= hi1, true) AND coalesce(r2 <= hi2, true)
       AND coalesce(r3 <= hi3, true) AND coalesce(r4 <= hi4, true) AS kept
FROM p
"""


_WORDS = "list_filter(regexp_split_to_array(" + _LOW.format("coalesce(text, '')") + ", '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ig AS (SELECT item_id, len(w) AS m, len(w) - 4 AS k, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) AS g FROM iw WHERE len(w) >= 5),
ic AS (SELECT item_id, m, k, g, count(*) AS c FROM ig GROUP BY ALL),
dg AS (
  SELECT doc_id, nw, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, len(w) AS nw, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hit AS (SELECT DISTINCT doc_id, item_id, m, k, pos, nw FROM dg JOIN ic USING (g)),
bag AS (
  SELECT h.doc_id, h.item_id, h.m, h.k, h.pos, h.nw, d.g, count(*) AS c
  FROM hit h JOIN dg d ON d.doc_id = h.doc_id AND d.pos >= h.pos AND d.pos < h.pos + h.k GROUP BY ALL),
sim AS (
  SELECT b.doc_id, b.item_id, b.pos, b.m, b.nw, sum(least(b.c, ic.c)) AS inter, any_value(b.k) + least(any_value(b.k), any_value(b.nw) - 4 - b.pos) AS tot
  FROM bag b JOIN ic ON ic.item_id = b.item_id AND ic.g = b.g GROUP BY b.doc_id, b.item_id, b.pos, b.m, b.nw)
SELECT doc_id, item_id, pos::BIGINT AS start, least(m, nw - pos)::BIGINT AS n_words, round(inter / (tot - inter), 6) AS similarity
FROM sim WHERE 100 * inter >= 80 * (tot - inter)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY inter / (tot - inter) DESC, pos) = 1
"""

_HOST = "CASE WHEN contains(u, '://') THEN translate(regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN contains(u, '://') THEN regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"

URL_FILTER = f"""
WITH u0 AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
u1 AS (SELECT *, {_HOST} AS host, {_PATH} AS path FROM u0),
u2 AS (
  SELECT *, string_split(host, '.') AS hp,
         list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> '') AS pp FROM u1),
tok AS (
  SELECT page_id, host, path, list_distinct(list_filter([
    CASE WHEN regexp_extract(u, '^([A-Za-z]+)://', 1) <> '' THEN 'scheme=' || regexp_extract(u, '^([A-Za-z]+)://', 1) END,
    CASE WHEN regexp_extract(path, '\\.([A-Za-z]+)$', 1) <> '' THEN 'ending=' || regexp_extract(path, '\\.([A-Za-z]+)$', 1) END,
    CASE WHEN contains(u, '#') THEN 'fragment' END]
    || list_transform(list_filter(list_transform(range(1, len(hp) + 1), lambda k: array_to_string(hp[k:], '.')), lambda x: x <> ''), lambda x: 'domain=' || x)
    || list_transform(list_filter(hp[1:greatest(len(hp) - 2, 1)], lambda x: x <> ''), lambda x: 'label=' || x)
    || list_transform(range(len(pp)), lambda k: 'path' || k || '=' || pp[k + 1])
    || list_transform(regexp_extract_all(u, '[?&]([^=&#]+)', 1), lambda k: 'key=' || k), lambda x: x IS NOT NULL)) AS t
  FROM u2),
mark AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
basket AS (SELECT page_id, t, bad FROM tok JOIN mark ON page_id = doc_id),
least_n AS (SELECT ceil(greatest(0.002 * count(*), least(count(*), 5))) AS m FROM basket),
one AS (
  SELECT token, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM (SELECT bad, unnest(t) AS token FROM basket)
  GROUP BY token HAVING count(*) FILTER (WHERE bad) >= (SELECT m FROM least_n)),
-- a set with a token that is a rule by itself adds nothing, nor does one with a token too rare to be in any
few AS (SELECT page_id, bad, list(token ORDER BY token) AS t FROM (SELECT page_id, bad, unnest(t) AS token FROM basket) JOIN one USING (token) WHERE 2 * n_bad < n GROUP BY page_id, bad),
sub AS (
  SELECT list_filter(t, lambda x, i: (b >> (i - 1)) & 1 = 1) AS items, bad
  FROM (SELECT t, bad, unnest(range(1, (1 << len(t))::BIGINT)) AS b FROM few)),
ruled AS (
  SELECT [token] AS items FROM one WHERE 2 * n_bad >= n UNION ALL
  SELECT items FROM sub GROUP BY items
  HAVING count(*) FILTER (WHERE bad) >= (SELECT m FROM least_n) AND 2 * count(*) FILTER (WHERE bad) >= count(*)),
verdicts AS (SELECT t.*, EXISTS (SELECT 1 FROM ruled r WHERE list_has_all(t.t, r.items)) AS hit FROM tok t),
fits AS (
  SELECT v.*, g.column2 || g.column3 AS rule, g.column1 AS act
  FROM verdicts v LEFT JOIN (VALUES (0, 'allow', 'org', '/'), (1, 'block', 'example.org', '/es/'), (2, 'block', 'example.org', '/en/1'), (3, 'allow', 'com', '/fr/'), (4, 'block', 'com', '/de/')) g(column0, column1, column2, column3)
  ON (host = g.column2 OR ends_with(host, '.' || g.column2)) AND starts_with(path, g.column3))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(act, length(rule)), CASE WHEN bool_or(hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits GROUP BY page_id
"""


#: CRC-32 of a string's UTF-8 bytes, by its table of 256 entries; {0}: the string, ``tab`` is a column beside it.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
_BYTES = "list_transform(range(length(hex({0})) // 2), lambda i: ('0x' || substr(hex({0}), 2 * i + 1, 2))::BIGINT)"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

IMPORTANCE = f"""
WITH d AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w0 AS (SELECT kind, doc_id, list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM d),
w AS (SELECT kind, doc_id, unnest(w) AS word FROM w0),
v AS (SELECT word, {_CRC.format("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), {_CRC_TABLE}),
f AS (SELECT kind, doc_id, bucket FROM w JOIN v USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM f GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY doc_id),
x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN m USING (doc_id)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 AS size FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= size THEN place END::BIGINT AS rank FROM z
"""

CONVERSATION_TRIE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("conv_id::VARCHAR")} % 9 AS h FROM n, {_CRC_TABLE}),
cc AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN n b ON b.conv_id = c.base),
r AS (
  SELECT cc.conv_id, pos AS depth, role, text FROM cc JOIN t ON t.conv_id = cc.base AND pos <= h
  UNION ALL SELECT cc.conv_id, pos - h + taken, role, text FROM cc JOIN t ON t.conv_id = cc.conv_id AND pos > h),
p AS (
  SELECT conv_id, depth, strlen(text) AS bytes, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM n),
q AS (
  SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
q2 AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM q),
v AS (
  SELECT depth, node, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM q2 GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
u AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (depth, node)),
s AS (
  SELECT q2.depth, q2.node, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM u JOIN q2 ON q2.conv_id = u.node AND q2.depth <= u.depth GROUP BY q2.depth, q2.node)
SELECT node AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM u JOIN s USING (depth, node)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op2_decontaminate": DECONTAMINATE, "op5_url_filter": URL_FILTER, "op9_quality_rules": QUALITY_RULES, "op11_importance_sample": IMPORTANCE, "op12_conversation_trie": CONVERSATION_TRIE}
