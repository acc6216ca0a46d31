"""DuckDB SQL for the news queries, put together from the same vocabulary."""

from __future__ import annotations

from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import FACTORS, stems, weights_for
from ledeforge.plans import views


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lst(v) if isinstance(v, list) else q(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q('(?i)' + pattern)})"


def any_of(col: str, patterns: list[str]) -> str:
    return has(col, "(?:" + "|".join(patterns) + ")")


NOW = f"TIMESTAMP '{views.NOW}'"
EVENTS = f"""ne AS (
  SELECT event_id::BIGINT AS seq, {lst(views.HEADLINES)}[event_id % {len(views.HEADLINES)} + 1] AS title, {lst(views.SOURCES)}[user_id % {len(views.SOURCES)} + 1] AS source,
         CASE WHEN list_contains({lst(views.MACRO_SOURCES)}, {lst(views.SOURCES)}[user_id % {len(views.SOURCES)} + 1]) THEN 'macro' ELSE 'crypto' END AS bucket,
         {lst(views.TAGSETS)}[event_id % {len(views.TAGSETS)} + 1] AS tags, {NOW} - to_minutes((event_id * 7919 % 2880)::INT) AS published_at,
         'https://example.com/s/' || (event_id % 500) || '/?u=' || user_id AS url, repeat('word ', (event_id % 60)::INT) AS summary, (event_id % 6 + 1)::INT AS source_count
  FROM events)"""
DOCS = f"""nd AS (
  SELECT doc_id::BIGINT AS seq, (doc_id // {views.BATCH_ITEMS})::VARCHAR AS batch, string_split(text, chr(10))[1] AS title, source,
         CASE WHEN doc_id % 3 = 0 THEN 'macro' ELSE 'crypto' END AS bucket, [lang] AS tags, {NOW} - to_minutes((doc_id * 7919 % 2880)::INT) AS published_at,
         'https://example.com/d/' || doc_id AS url, text AS summary, 1 AS source_count
  FROM documents)"""

# the look-aheads of a price, for an engine without them: numbers with a unit become a mark before the search
_UNITS = r"[\d,.]+(?:\s*(?:billion|million|trillion|years?)\b|[MBK]\b|-day\b)"
_PLAIN_PRICE = r"(?:\$[\d,.]+|[\d,.]+\s*(?:USDT|USD)\b|[\d,.]*\d(?:[^\w,.]|$))"
_MARKED = f"regexp_replace(title, {q('(?i)' + _UNITS)}, '#', 'g')"
TICK = f"(({has(_MARKED, V.TICK_LEAD + _PLAIN_PRICE)} OR {any_of('title', V.TICK_OTHERS)}) AND NOT {has('title', V.CONTINUATION)})"
REJECT = f"""CASE WHEN length(trim(title)) < {V.MIN_TITLE} THEN 'no_title' WHEN {any_of('title', V.CLICKBAIT)} THEN 'clickbait' WHEN {TICK} THEN 'price_tick'
  WHEN bucket = 'macro' AND NOT {any_of('title', V.MACRO_RELEVANT)} AND {any_of('title', V.MACRO_OFFTOPIC)} THEN 'macro_offtopic' END"""
_ALL_TEXT = "(title || ' ' || array_to_string(tags, ' '))"
CATEGORY = "CASE " + " ".join(f"WHEN {has(_ALL_TEXT, V.any_word(*V.CATEGORY_WORDS[c]))} THEN {q(c)}" for c in V.CATEGORIES) + " END"
SUBJECT = "CASE " + " ".join(f"WHEN {has('title', p)} THEN {q(n)}" for n, p in V.SUBJECTS) + " END"
_LOW_TEXT = f"lower{_ALL_TEXT}"
KEYWORD = "CASE " + " ".join(f"WHEN regexp_matches({_LOW_TEXT}, {q(stems(t))}) THEN {V.TIER_SCORES[t]}" for t in sorted(V.KEYWORD_TIERS)) + " ELSE 0.0 END"
KEYWORD_WHY = "CASE " + " ".join(f"WHEN regexp_matches({_LOW_TEXT}, {q(stems(t))}) THEN 'tier {t} ''' || regexp_extract({_LOW_TEXT}, {q(stems(t))}, 1) || ''''" for t in sorted(V.KEYWORD_TIERS)) + " ELSE 'no tier keyword' END"
AGE = f"((epoch_us({NOW}) - epoch_us(published_at)) / 3.6e9)"
RECENCY = f"greatest(0.0::DOUBLE, 1.0 - greatest(0.0::DOUBLE, {AGE}) / {V.WINDOW_HOURS}.0)"
QUALITY = "CASE source " + " ".join(f"WHEN {q(s)} THEN {w}" for s, w in V.SOURCE_QUALITY.items()) + f" ELSE {V.DEFAULT_QUALITY} END"
_TAGS = "list_transform(list_filter(tags, lambda t: t <> ''), lambda t: replace(lower(t), '_', '-'))"
_GOOD = f"list_filter({lst(V.RELEVANT_TAGS)}, lambda t: list_contains({_TAGS}, t))"
_BAD = f"list_filter({lst(V.OFFTOPIC_TAGS)}, lambda t: list_contains({_TAGS}, t))"
TOPICALITY = f"CASE WHEN len({_TAGS}) = 0 THEN 0.5 WHEN len({_GOOD}) > 0 THEN 1.0 WHEN len({_BAD}) > 0 THEN 0.0 ELSE 0.5 END"
TOPICALITY_WHY = f"CASE WHEN len({_TAGS}) = 0 THEN 'no tags (neutral)' WHEN len({_GOOD}) > 0 THEN 'relevant tag ''' || list_min({_GOOD}) || '''' WHEN len({_BAD}) > 0 THEN 'off-topic tag ''' || list_min({_BAD}) || '''' ELSE 'tags present but unmapped' END"
COUNT = "CASE WHEN source_count = 1 THEN 0.0 WHEN source_count = 2 THEN 0.20 WHEN source_count <= 4 THEN 0.55 ELSE 1.0 END"
COUNT_WHY = "CASE WHEN source_count = 1 THEN 'single source' WHEN source_count <= 4 THEN source_count || ' sources' ELSE source_count || ' sources (saturated)' END"
_HITS = f"regexp_extract_all(title, {q('(?i)' + V.FIGURE)})"
NUMERIC = f"CASE len({_HITS}) WHEN 0 THEN 0.0 WHEN 1 THEN 0.35 WHEN 2 THEN 0.75 ELSE 1.0 END"
NUMERIC_WHY = f"CASE len({_HITS}) WHEN 0 THEN 'no figure in headline' WHEN 1 THEN 'one figure (' || trim({_HITS}[1]) || ')' WHEN 2 THEN 'two figures' ELSE len({_HITS}) || ' figures' END"
_FRAMED, _SAID, _LONG = has("title", V.FRAMING), f"({has('title', V.ATTRIBUTION)} OR regexp_matches(title, {q(V.COLON_SOURCE)}))", f"length(summary) > {V.LONG_SUMMARY}"
ANALYSIS = f"least(1.0::DOUBLE, CASE WHEN {_FRAMED} THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN {_SAID} THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN {_LONG} THEN 0.15::DOUBLE ELSE 0 END)"
ANALYSIS_WHY = f"coalesce(nullif(concat_ws(', ', CASE WHEN {_FRAMED} THEN 'framing' END, CASE WHEN {_SAID} THEN 'attributed view' END, CASE WHEN {_LONG} THEN 'long summary' END), ''), 'straight report')"
ASSET = "CASE " + " ".join(f"WHEN {has('title', p)} THEN {s}" for s, p, _ in V.ASSETS) + " ELSE 0.5 END"
ASSET_WHY = "CASE " + " ".join(f"WHEN {has('title', p)} THEN {q(t)}" for _, p, t in V.ASSETS) + " ELSE 'no specific asset' END"
QUALITY_WHY = f"CASE WHEN list_contains({lst(list(V.SOURCE_QUALITY))}, source) THEN source ELSE source || ' (unrated)' END"
RAW = {"keyword": KEYWORD, "recency": RECENCY, "source_quality": QUALITY, "topicality": TOPICALITY, "source_count": COUNT, "numeric": NUMERIC, "analysis": ANALYSIS, "asset": ASSET}
WHY = {"keyword": KEYWORD_WHY, "source_quality": QUALITY_WHY, "topicality": TOPICALITY_WHY, "source_count": COUNT_WHY, "numeric": NUMERIC_WHY, "analysis": ANALYSIS_WHY, "asset": ASSET_WHY}


def factors(src: str = "ne", name: str = "fa") -> str:
    """All raw factors, with category and subject."""
    return f"{name} AS (SELECT *, " + ", ".join(f"({RAW[n]})::DOUBLE AS raw_{n}" for n in FACTORS) + f", {CATEGORY} AS cat, {SUBJECT} AS subject FROM {src})"


def total(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"{w!r}::DOUBLE * raw_{n}" for n, w in weights.items()) + f") / {sum(weights.values())!r}::DOUBLE"


def scored(depth: str = "balanced", src: str = "fa", name: str = "sc") -> str:
    return f"{name} AS (SELECT *, {total(weights_for(depth))} AS score FROM {src})"


def selected(part: str, lo: str, hi: str, src: str = "sc", name: str = "sel", cap: int = V.MAX_PER_SUBJECT) -> str:
    """The adaptive selection over ``src``."""
    return f"""{name}1 AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, seq) AS rk, count(*) FILTER (WHERE score >= {V.SCORE_THRESHOLD}) OVER (PARTITION BY {part}) AS g FROM {src}),
{name}2 AS (SELECT *, subject IS NULL OR row_number() OVER (PARTITION BY {part}, subject ORDER BY rk) <= {cap} AS ok FROM {name}1 WHERE rk <= CASE WHEN g < {lo} THEN {lo} ELSE g END),
{name}3 AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY {part} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS pos, least(count(*) FILTER (WHERE ok) OVER (PARTITION BY {part}), {hi}) AS np FROM {name}2),
{name}4 AS (SELECT *, count(*) FILTER (WHERE NOT ok AND pos < {hi}) OVER (PARTITION BY {part} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hrk FROM {name}3),
{name}5 AS (SELECT *, NOT ok AND pos < {hi} AND hrk <= {lo} - np AS backfill FROM {name}4),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, backfill, rk) AS pick FROM {name}5 WHERE (ok AND pos <= {hi}) OR backfill QUALIFY pick <= {hi})"""


def mapped(expr: str, pairs: dict[str, str]) -> str:
    return f"coalesce(MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in pairs.items())}}}[{expr}], {expr})"


def normal(text: str) -> str:
    low = f"regexp_replace(replace(lower({text}), ',', ''), '(\\d)\\.0+\\b', '\\1', 'g')"
    parts = f"regexp_split_to_array(regexp_replace({low}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+')"
    folds = {form: root for root, forms in V.VERBS.items() for form in forms}
    one = f"list_transform(list_filter({parts}, lambda t: length(t) >= 2), lambda t: {mapped('t', V.TICKERS)})"
    return f"list_filter(list_transform({one}, lambda t: {mapped('t', folds)}), lambda t: NOT list_contains({lst(V.STOPWORDS)}, t))"


# letters beyond ASCII count as parts of words
_ASCII = "regexp_replace(title, '[^\\x00-\\x7F]', '_', 'g')"
_NOUNS = f"list_filter(list_transform(regexp_extract_all({_ASCII}, {q(V.PROPER_NOUN)}, 1), lambda t: lower(t)), lambda t: NOT list_contains({lst(V.ENTITY_IGNORE)}, t))"
_NUMBERS = "list_filter(list_transform(regexp_extract_all(title, '(\\d[\\d,]*)', 1), lambda t: replace(t, ',', '')), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '(19|20)\\d\\d'))"
ENTITIES = f"list_distinct(list_transform({_NOUNS}, lambda t: {mapped('t', V.TICKERS)}) || {_NUMBERS})"
_GENERIC = lst(V.GENERIC_ENTITIES)

EDGES = f"""ents AS (SELECT batch, seq, {ENTITIES} AS e, list_distinct({normal('title')}) AS c FROM it),
gram0 AS (SELECT batch, seq, {normal("title || ' ' || array_to_string(tags, ' ')")} AS t FROM it),
gram AS (SELECT batch, seq, unnest(t || [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) AS term FROM gram0),
tf AS (SELECT batch, seq, term, count(*) AS tf FROM gram GROUP BY ALL),
voc AS (SELECT batch, term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY batch, term QUALIFY row_number() OVER (PARTITION BY batch ORDER BY sum(tf) DESC, term) <= {V.MAX_FEATURES}),
bn AS (SELECT batch, count(*) AS n FROM it GROUP BY batch),
tw AS (SELECT tf.batch, seq, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN voc USING (batch, term) JOIN bn USING (batch)),
tn AS (SELECT batch, seq, term, x / sqrt(sum(x * x) OVER (PARTITION BY batch, seq)) AS w FROM tw),
cosine AS (SELECT a.batch, a.seq AS a, b.seq AS b, sum(a.w * b.w) AS cosine FROM tn a JOIN tn b ON a.batch = b.batch AND a.term = b.term AND a.seq < b.seq GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= {V.DEDUPE_THRESHOLD}),
edf AS (SELECT batch, entity, count(*) AS df FROM (SELECT batch, unnest(e) AS entity FROM ents) GROUP BY ALL),
ceil AS (SELECT batch, greatest(2, least({V.RARE_MAX}, floor(n * {V.RARE_SHARE}))) AS ceiling FROM bn),
sharing AS (
  SELECT a.batch, a.seq AS a, b.seq AS b, list_intersect(a.e, b.e) AS s, len(list_distinct(a.e || b.e)) AS u, list_intersect(a.c, b.c) AS sc
  FROM ents a JOIN ents b ON a.batch = b.batch AND a.seq < b.seq WHERE len(list_filter(list_intersect(a.e, b.e), lambda x: NOT list_contains({_GENERIC}, x))) > 0),
same AS (SELECT batch, a, b FROM sharing WHERE len(s) >= 2 AND len(s) / u >= 0.5),
rare AS (
  SELECT h.batch, a, b FROM (SELECT *, list_filter(s, lambda x: NOT list_contains({_GENERIC}, x)) AS named FROM sharing) h
  LEFT JOIN (SELECT batch, list(entity) AS common FROM edf JOIN ceil USING (batch) WHERE df > ceiling GROUP BY batch) k ON k.batch = h.batch
  WHERE coalesce(len(list_intersect(named, common)), 0) = 0 AND len(list_filter(sc, lambda x: NOT list_contains(named, x))) > 0),
edge AS (SELECT a, b FROM cosine UNION SELECT a, b FROM same UNION SELECT a, b FROM rare),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(node, to_) AS (SELECT seq, seq FROM it UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.to_),
clus AS (SELECT it.batch, seq, min(to_) AS cluster FROM it JOIN reach ON node = seq GROUP BY ALL),
grp AS (SELECT c.cluster, count(*) AS n, count(DISTINCT source) AS outlets, list_sort(list(DISTINCT source)) AS sources, list_sort(list_distinct(flatten(list(tags)))) AS all_tags FROM it JOIN clus c USING (seq) GROUP BY c.cluster),
merged AS (
  SELECT it.* EXCLUDE (tags, source_count), CASE WHEN n > 1 THEN all_tags ELSE tags END AS tags, (CASE WHEN n > 1 THEN outlets ELSE 1 END)::INT AS source_count,
         CASE WHEN n > 1 THEN sources ELSE []::VARCHAR[] END AS merged_sources
  FROM grp JOIN it ON it.seq = grp.cluster)"""
