"""The catalogue of news queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeforge.functions import render, text
from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import FACTORS, breakdown, classify, primary_subject, title_and_tags, top_drivers, total, weakest, weights_for, with_factors
from ledeforge.operators import dedupe, filters, prefs, select, stats
from ledeforge.operators.readers import rank_signatures, signature, signature_pools, signatures
from ledeforge.plans import message_sql as msql
from ledeforge.plans import messages, ranking, sql, views
from ledeforge.runtime import materialize
from ledeforge.streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Readers of the multi-reader queries: (chat, categories, depth).
READERS = [("r1", list(V.CATEGORIES), "balanced"), ("r2", ["macro"], "data"), ("r3", ["flows", "regulation"], "analysis"), ("r4", ["protocol", "security"], "unheard")]
#: Printed scores lie this much higher, so that halves round alike in every engine.
TIE = 1e-9


def query(sql_text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql_text:
            _SQL[f.__name__] = sql_text
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.news_events(spark, sf_dir)


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = with_factors(_events(spark, sf_dir), views.now())
    return items.withColumns({"category": classify(title_and_tags()), "subject": primary_subject(F.col("title"))})


def _scored(spark: SparkSession, sf_dir: str, depth: str = "balanced") -> DataFrame:
    return _factors(spark, sf_dir).withColumn("score", total(weights_for(depth)))


def _r6(c: str | Column) -> Column:
    return F.round(c, 6)


_WITH = f"WITH {sql.EVENTS}"
_FACT = f"{_WITH}, {sql.factors()}"
_SCORED = f"{_FACT}, {sql.scored()}"


# ---- rejection, windows and caps ----


@query(f"{_WITH} SELECT seq, bucket, {sql.REJECT} AS reject FROM ne")
def reject_reason(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", "bucket", filters.reject_reason(F.col("title"), F.col("bucket")).alias("reject"))


@query(f"{_WITH} SELECT bucket, reason, count(*) AS n FROM (SELECT bucket, {sql.REJECT} AS reason FROM ne) WHERE reason IS NOT NULL GROUP BY ALL")
def reject_counts(spark, sf_dir):
    return stats.reject_counts(_events(spark, sf_dir).withColumn("reject", filters.reject_reason(F.col("title"), F.col("bucket"))), ["bucket"])


def _capped(spark, sf_dir):
    fresh = filters.within_window(filters.well_formed(_events(spark, sf_dir)), views.now())
    return filters.cap_per_source(fresh.withColumn("reject", filters.reject_reason(F.col("title"), F.col("bucket"))))


_CAPPED = f"""{_WITH}, fr AS (SELECT *, {sql.REJECT} AS reject FROM ne WHERE length(trim(title)) > 0 AND starts_with(url, 'http') AND published_at >= {sql.NOW} - INTERVAL {V.WINDOW_HOURS} HOUR),
cp AS (SELECT *, coalesce(sum((reject IS NULL)::INT) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kb FROM fr),
ca AS (SELECT * FROM cp WHERE kb < {V.MAX_PER_SOURCE})"""


@query(f"{_CAPPED} SELECT seq, source, reject FROM ca")
def window_cap_per_source(spark, sf_dir):
    return _capped(spark, sf_dir).select("seq", "source", "reject")


@query(f"{_CAPPED} SELECT label AS source, count(seq) FILTER (WHERE reject IS NULL) AS kept FROM (SELECT unnest({sql.lst([f[0] for f in V.FEEDS])}) AS label) LEFT JOIN ca ON source = label GROUP BY label")
def kept_per_source(spark, sf_dir):
    from ledeforge.sources.feeds import feeds_table

    return stats.kept_per_source(_capped(spark, sf_dir), feeds_table(spark))


# ---- categories ----


@query(f"{_WITH} SELECT seq, {sql.CATEGORY} AS category FROM ne")
def category_classify(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", classify(title_and_tags()).alias("category"))


@query(f"{_WITH} SELECT seq, category FROM (SELECT seq, {sql.CATEGORY} AS category FROM ne) WHERE category IN ('flows', 'macro')")
def category_filter(spark, sf_dir):
    return filters.category_filter(category_classify(spark, sf_dir), ["flows", "macro"])


@query(f"{_WITH} SELECT seq, category FROM (SELECT seq, {sql.CATEGORY} AS category FROM ne) WHERE category IN ('macro', 'flows', 'regulation')")
def category_semi_join(spark, sf_dir):
    readers = spark.createDataFrame(READERS[1:3], "chat_id string, categories array<string>, depth string")
    return filters.category_semi_join(category_classify(spark, sf_dir), readers).select("seq", "category")


@query(f"{_WITH} SELECT count(*) AS pool_before, count(*) FILTER (WHERE c IN ('flows', 'macro')) AS pool_after, true AS filtered_by_category FROM (SELECT {sql.CATEGORY} AS c FROM ne)")
def pool_stats(spark, sf_dir):
    return stats.pool_stats(category_classify(spark, sf_dir), {"flows", "macro"})


# ---- factors ----

_FACTOR_QUERIES = {
    "keyword_tier": "keyword", "recency": "recency", "source_quality": "source_quality", "topicality": "topicality",
    "corroboration": "source_count", "numeric_figures": "numeric", "analysis_style": "analysis", "asset_class": "asset",
}


def _factor_query(name: str, factor: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw, why = FACTORS[factor](views.now())
        out = [F.col("seq"), _r6(raw.cast("double")).alias("raw")]
        return _events(spark, sf_dir).select(*out, *([] if factor == "recency" else [why.alias("reason")]))

    run.__name__ = name
    why = f", {sql.WHY[factor]} AS reason" if factor in sql.WHY else ""
    query(f"{_WITH} SELECT seq, round(({sql.RAW[factor]})::DOUBLE, 6) AS raw{why} FROM ne")(run)


for _n, _f in _FACTOR_QUERIES.items():
    _factor_query(_n, _f)


@query(f"{_WITH} SELECT seq, {sql.SUBJECT} AS subject FROM ne")
def primary_subject_query(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", primary_subject(F.col("title")).alias("subject"))


def _score_query(depth: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(spark, sf_dir, depth).select("seq", _r6(F.col("score") + TIE).alias("score"))

    run.__name__ = f"score_{depth}"
    query(f"{_FACT}, {sql.scored(depth)} SELECT seq, round(score + 1e-9, 6) AS score FROM sc")(run)


for _d in V.DEPTH_SPLITS:
    _score_query(_d)

CUSTOM = {"keyword": 2.0, "recency": 1.0, "asset": 0.5}


@query(f"{_FACT} SELECT seq, round({sql.total(CUSTOM)} + 1e-9, 6) AS score FROM fa")
def score_custom_weights(spark, sf_dir):
    return with_factors(_events(spark, sf_dir), views.now(), list(CUSTOM)).select("seq", _r6(total(CUSTOM) + TIE).alias("score"))


_W = weights_for()
_LONG = " UNION ALL ".join(f"SELECT seq, {k} AS ord, '{n}' AS name, raw_{n} AS raw, {w!r}::DOUBLE AS weight, raw_{n} * {w!r}::DOUBLE AS contribution FROM fa" for k, (n, w) in enumerate(_W.items()))


def _broken_down(spark, sf_dir):
    return _factors(spark, sf_dir).withColumn("f", breakdown(_W))


@query(f"{_FACT}, lo AS ({_LONG}) SELECT seq, ord, name, round(raw, 6) AS raw, weight, round(contribution, 6) AS contribution FROM lo")
def breakdown_long(spark, sf_dir):
    return _broken_down(spark, sf_dir).select("seq", F.explode("f").alias("f")).select("seq", "f.ord", "f.name", _r6("f.raw").alias("raw"), "f.weight", _r6("f.contribution").alias("contribution"))


@query(f"{_FACT}, lo AS ({_LONG}) SELECT seq, string_agg(name, ',' ORDER BY contribution DESC, ord) AS drivers FROM (SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY seq ORDER BY contribution DESC, ord) <= 3) GROUP BY seq")
def top_drivers_query(spark, sf_dir):
    return _broken_down(spark, sf_dir).select("seq", F.array_join(F.transform(top_drivers(F.col("f"), 3), lambda x: x["name"]), ",").alias("drivers"))


@query(f"{_FACT}, lo AS ({_LONG}) SELECT seq, name AS weakest FROM lo QUALIFY row_number() OVER (PARTITION BY seq ORDER BY contribution, ord) = 1")
def weakest_factor(spark, sf_dir):
    return _broken_down(spark, sf_dir).select("seq", weakest(F.col("f")).alias("weakest"))


@query(f"{_FACT} SELECT bucket, round(avg(raw_numeric), 6) AS mean, round(stddev_pop(raw_numeric), 6) AS stddev, count(DISTINCT raw_numeric) AS levels FROM fa GROUP BY bucket")
def numeric_spread(spark, sf_dir):
    f = _factors(spark, sf_dir)
    return f.groupBy("bucket").agg(_r6(F.avg("raw_numeric")).alias("mean"), _r6(F.stddev_pop("raw_numeric")).alias("stddev"), F.count_distinct("raw_numeric").alias("levels"))


# ---- ranking and selection ----


@query(f"{_SCORED} SELECT seq, round(score + 1e-9, 6) AS score FROM sc ORDER BY sc.score DESC, seq LIMIT 10")
def rank_top_n(spark, sf_dir):
    return select.top_n(_scored(spark, sf_dir), 10).select("seq", _r6(F.col("score") + TIE).alias("score"))


@query(f"{_SCORED} SELECT seq, round(score + 1e-9, 6) AS score FROM sc ORDER BY sc.score DESC, seq LIMIT 1 OFFSET 2")
def why_nth(spark, sf_dir):
    return select.nth(_scored(spark, sf_dir), 3).select("seq", _r6(F.col("score") + TIE).alias("score"))


def _selected(spark, sf_dir):
    lo, hi = ranking.limits(F.col("bucket"))
    return select.select_top(_scored(spark, sf_dir).withColumns({"_lo": lo, "_hi": hi}), ["bucket"], F.col("_lo"), F.col("_hi"))


_LO = f"(CASE bucket WHEN 'crypto' THEN {V.LIMITS['crypto'][0]} ELSE {V.LIMITS['macro'][0]} END)"
_HI = f"(CASE bucket WHEN 'crypto' THEN {V.LIMITS['crypto'][1]} ELSE {V.LIMITS['macro'][1]} END)"
_SELECTED = f"{_SCORED}, {sql.selected('bucket', _LO, _HI)}"


@query(f"{_SELECTED} SELECT bucket, pick, seq, subject, round(score + 1e-9, 6) AS score, backfill FROM sel")
def select_adaptive(spark, sf_dir):
    return _selected(spark, sf_dir).select("bucket", F.col("pick").cast("long").alias("pick"), "seq", "subject", _r6(F.col("score") + TIE).alias("score"), "backfill")


@query(f"{_SCORED}, {sql.selected('source', '8', '12', 'sc', cap=2)} SELECT source, pick, seq, subject, backfill FROM sel")
def subject_cap(spark, sf_dir):
    return select.select_top(_scored(spark, sf_dir), ["source"], 8, 12, max_per_subject=2).select("source", F.col("pick").cast("long").alias("pick"), "seq", "subject", "backfill")


@query(f"{_SELECTED} SELECT row_number() OVER (ORDER BY score DESC, bucket, seq) AS place, bucket, seq FROM sel")
def final_merge(spark, sf_dir):
    from pyspark.sql import Window

    merged = select.final_merge(_selected(spark, sf_dir))
    # a dozen and a half rows: the order of all is the result
    return merged.select(F.row_number().over(Window.orderBy(F.desc("score"), "bucket_ord", "seq")).cast("long").alias("place"), "bucket", "seq")


# ---- words, entities and dedupe ----


def _docs(spark, sf_dir):
    return views.news_docs(spark, sf_dir)


_DOCS = f"WITH {sql.DOCS}"
_DEDUPE = f"WITH RECURSIVE {sql.DOCS}, it AS (SELECT * FROM nd), {sql.EDGES}"
_ITEMS = f"{_DOCS}, {sql.EVENTS}, it AS (SELECT seq, title FROM nd UNION ALL SELECT -1 - seq, title FROM ne)"


def _titles(spark, sf_dir):
    heads = _events(spark, sf_dir).select((-1 - F.col("seq")).alias("seq"), "title")
    return _docs(spark, sf_dir).select("seq", "title").union(heads)


@query(f"{_ITEMS} SELECT seq, array_to_string({sql.normal('title')}, ' ') AS tokens FROM it")
def normalize_title(spark, sf_dir):
    return _titles(spark, sf_dir).select("seq", F.array_join(text.normal_tokens(F.col("title")), " ").alias("tokens"))


@query(f"{_ITEMS} SELECT seq, array_to_string(list_sort({sql.ENTITIES}), ' ') AS entities FROM it")
def entity_tokens(spark, sf_dir):
    return _titles(spark, sf_dir).select("seq", F.array_join(F.sort_array(text.entity_tokens(F.col("title"))), " ").alias("entities"))


@query(f"{_ITEMS} SELECT seq, array_to_string(list_sort(list_distinct({sql.normal('title')})), ' ') AS tokens FROM it")
def content_tokens(spark, sf_dir):
    return _titles(spark, sf_dir).select("seq", F.array_join(F.sort_array(text.content_tokens(F.col("title"))), " ").alias("tokens"))


@query(f"{_DEDUPE} SELECT batch, entity, df FROM edf")
def entity_df(spark, sf_dir):
    return dedupe.entity_df(_docs(spark, sf_dir))


@query(f"{_DEDUPE} SELECT batch, ceiling::BIGINT AS ceiling FROM ceil")
def rarity_ceiling(spark, sf_dir):
    n = _docs(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return n.select("batch", dedupe.rarity_ceiling(F.col("n")).cast("long").alias("ceiling"))


@query(f"{_DEDUPE} SELECT batch, seq, term, round(w, 6) AS w FROM tn")
def tfidf_weights(spark, sf_dir):
    return dedupe.tfidf(_docs(spark, sf_dir)).select("batch", "seq", "term", _r6("w").alias("w"))


@query(f"{_DEDUPE} SELECT batch, a, b, round(cosine, 6) AS cosine FROM cosine")
def edges_cosine(spark, sf_dir):
    return dedupe.edges_cosine(_docs(spark, sf_dir)).select("batch", "a", "b", _r6("cosine").alias("cosine"))


@query(f"{_DEDUPE} SELECT batch, a, b FROM same")
def edges_same_event(spark, sf_dir):
    return dedupe.edges_same_event(_docs(spark, sf_dir))


@query(f"{_DEDUPE} SELECT batch, a, b FROM rare")
def edges_rare(spark, sf_dir):
    return dedupe.edges_rare(_docs(spark, sf_dir))


@query(f"{_DEDUPE} SELECT batch, seq, cluster FROM clus")
def dedupe_clusters(spark, sf_dir):
    return dedupe.clusters(_docs(spark, sf_dir))


_MERGED = "seq, batch, title, source, array_to_string(tags, ',') AS tags, source_count, array_to_string(merged_sources, ',') AS merged_sources"


@query(f"{_DEDUPE} SELECT {_MERGED} FROM merged")
def dedupe_merged(spark, sf_dir):
    m = dedupe.dedupe(_docs(spark, sf_dir))
    return m.select("seq", "batch", "title", "source", F.array_join("tags", ",").alias("tags"), "source_count", F.array_join("merged_sources", ",").alias("merged_sources"))


# ---- whole runs ----

_RUN = f"""WITH RECURSIVE {sql.DOCS}, it AS (SELECT * REPLACE (batch || '/' || bucket AS batch) FROM nd), {sql.EDGES},
named AS (SELECT m.*, c.cat0 FROM merged m JOIN (SELECT seq, {sql.CATEGORY} AS cat0 FROM nd) c USING (seq)), {sql.factors('named')}, {sql.scored()}, {sql.selected('batch', _LO, _HI)}"""


@query(f"{_RUN} SELECT batch, bucket, pick, seq, cat0 AS category, source_count, round(score + 1e-9, 6) AS score FROM sel")
def news_pipeline(spark, sf_dir):
    r = ranking.run(_docs(spark, sf_dir), views.now(), batch=F.col("batch"))
    return r.items.select("batch", "bucket", F.col("pick").cast("long").alias("pick"), "seq", "category", "source_count", _r6(F.col("score") + TIE).alias("score"))


@query(
    f"{_RUN} SELECT bucket, sum(f)::BIGINT AS fetched, sum(m)::BIGINT AS after_dedupe, sum(s)::BIGINT AS selected FROM (SELECT bucket, 1 AS f, 0 AS m, 0 AS s FROM nd UNION ALL SELECT bucket, 0, 1, 0 FROM merged UNION ALL SELECT bucket, 0, 0, 1 FROM sel) GROUP BY ROLLUP (bucket)"
)
def bucket_rollup(spark, sf_dir):
    return ranking.run(_docs(spark, sf_dir), views.now(), batch=F.col("batch")).counts


@query(f"{_CAPPED} SELECT count(*) AS items_kept, count(DISTINCT source) AS sources, count(*) FILTER (WHERE bucket = 'crypto') AS crypto, count(*) FILTER (WHERE bucket = 'macro') AS macro FROM ca WHERE reject IS NULL")
def pipeline_stats(spark, sf_dir):
    kept = _capped(spark, sf_dir).filter(F.col("reject").isNull())
    return kept.agg(F.count(F.lit(1)).alias("items_kept"), F.count_distinct("source").alias("sources"), F.count_if(F.col("bucket") == "crypto").alias("crypto"), F.count_if(F.col("bucket") == "macro").alias("macro"))


# ---- readers ----


def _readers(spark):
    p = spark.createDataFrame(READERS, "chat_id string, categories array<string>, depth string")
    return p.select("chat_id", prefs.sane_categories(F.col("categories")).alias("categories"), prefs.sane_depth(F.col("depth")).alias("depth"))


def _reader_sql() -> str:
    parts = []
    for chat, cats, depth in READERS:
        where = "" if set(cats) == set(V.CATEGORIES) else f"WHERE cat IN ({', '.join(map(sql.q, cats))})"
        parts.append(f"SELECT '{chat}' AS chat_id, *, {sql.total(weights_for(depth))} AS score FROM fa {where}")
    return f"{_FACT}, sc AS ({' UNION ALL '.join(parts)}), {sql.selected('chat_id, bucket', _LO, _HI)}"


def _reader_picks(spark, sf_dir):
    lo, hi = ranking.limits(F.col("bucket"))
    readers = _readers(spark)
    named = readers.select("chat_id", signature(F.col("categories"), F.col("depth")).alias("signature"))
    return rank_signatures(_factors(spark, sf_dir), signatures(readers), lo, hi).join(named, "signature")


@query(f"{_reader_sql()} SELECT chat_id, bucket, pick, seq, round(score + 1e-9, 6) AS score FROM sel")
def multi_reader_ranking(spark, sf_dir):
    return _reader_picks(spark, sf_dir).select("chat_id", "bucket", F.col("pick").cast("long").alias("pick"), "seq", _r6(F.col("score") + TIE).alias("score"))


@query(f"{_reader_sql()} SELECT chat_id, count(*) AS n, count(*) FILTER (WHERE raw_numeric > 0) AS numeric, count(*) FILTER (WHERE raw_analysis > 0) AS analysis FROM sel GROUP BY chat_id")
def depth_coverage(spark, sf_dir):
    return prefs.depth_coverage(_reader_picks(spark, sf_dir), ["chat_id"])


def _stored(spark, sf_dir):
    return prefs.parse_prefs(views.stored_prefs(spark, sf_dir))


_USERS = f"""us0 AS (SELECT DISTINCT user_id AS chat FROM events WHERE user_id IS NOT NULL),
us AS (SELECT chat, chat % 9 <> 0 AS fine, list_filter([{', '.join(f"CASE WHEN (chat >> {k}) & 1 = 1 THEN {sql.q(c)} END" for k, c in enumerate(V.CATEGORIES))}], lambda x: x IS NOT NULL) AS bits, {sql.lst([*V.DEPTH_SPLITS, 'balanced'])}[chat % 4 + 1] AS depth FROM us0),
st AS (SELECT chat, fine, list_sort(CASE WHEN len(bits) = 0 THEN {sql.lst(V.CATEGORIES)} ELSE bits END) AS cats, depth FROM us)"""
_ALL_SORTED = sql.q(",".join(sorted(V.CATEGORIES)))


@query(f"WITH {_USERS} SELECT chat::VARCHAR AS chat_id, array_to_string(cats, ',') AS categories, depth FROM st WHERE fine")
def prefs_sanitize(spark, sf_dir):
    return _stored(spark, sf_dir).select("chat_id", F.array_join("categories", ",").alias("categories"), "depth")


@query(f"WITH {_USERS} SELECT chat::VARCHAR AS chat_id, CASE WHEN fine THEN array_to_string(cats, ',') ELSE {_ALL_SORTED} END AS categories, CASE WHEN fine THEN depth ELSE 'balanced' END AS depth FROM st")
def prefs_default(spark, sf_dir):
    chats = views.stored_prefs(spark, sf_dir).select(F.col("chat").cast("string").alias("chat_id"))
    return prefs.prefs_or_default(chats, _stored(spark, sf_dir)).select("chat_id", F.array_join("categories", ",").alias("categories"), "depth")


_ACTIONS = ["cat:macro", "depth:analysis", "all:", "cat:bogus", "depth:loud", "nothing"]


@query(
    f"""WITH {_USERS}, ac AS (SELECT *, {sql.lst(_ACTIONS)}[chat % {len(_ACTIONS)} + 1] AS action FROM st WHERE fine)
SELECT chat::VARCHAR AS chat_id, array_to_string(CASE action WHEN 'cat:macro' THEN CASE WHEN list_contains(cats, 'macro') THEN list_filter(cats, lambda c: c <> 'macro') ELSE list_sort(list_append(cats, 'macro')) END WHEN 'all:' THEN {sql.lst(sorted(V.CATEGORIES))} ELSE cats END, ',') AS categories, CASE action WHEN 'depth:analysis' THEN 'analysis' ELSE depth END AS depth FROM ac"""
)
def prefs_toggle(spark, sf_dir):
    action = views.dealt(_ACTIONS, F.col("chat_id").cast("long"))
    return prefs.apply_actions(_stored(spark, sf_dir), action).select("chat_id", F.array_join("categories", ",").alias("categories"), "depth")


# ---- rendered scalars ----


@query("SELECT page_id, regexp_replace(string_split(url, '?')[1], '/+$', '') AS key FROM pages")
def url_key(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.url_key(F.col("url")).alias("key"))


@query("SELECT page_id, substr(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), 1, 400) AS plain FROM pages")
def strip_html(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_html(F.col("html"), V.SUMMARY_CHARS).alias("plain"))


@query("SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.html_escape(F.col("url")).alias("escaped"))


_BADGE = f"CASE WHEN cat IS NULL THEN '📰 General' ELSE MAP {{{', '.join(f'{sql.q(c)}: {sql.q(V.CATEGORY_EMOJI[c])}' for c in V.CATEGORIES)}}}[cat] || ' ' || string_split(MAP {{{', '.join(f'{sql.q(c)}: {sql.q(V.CATEGORY_LABELS[c])}' for c in V.CATEGORIES)}}}[cat], ' &')[1] END"


@query(f"{_FACT} SELECT seq, {_BADGE} AS badge FROM fa")
def badge(spark, sf_dir):
    return category_classify(spark, sf_dir).select("seq", render.badge(F.col("category")).alias("badge"))


@query(f"{_SCORED} SELECT seq, CASE WHEN round(score + 1e-9, 2) >= {V.STRONG_AT} THEN 'Strong' WHEN round(score + 1e-9, 2) >= {V.NOTABLE_AT} THEN 'Notable' ELSE 'Context' END AS band FROM sc")
def signal_band(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", render.signal_band(F.col("score") + TIE).alias("band"))


@query(f"{_WITH} SELECT seq, CASE WHEN {sql.AGE} < 1 THEN trunc({sql.AGE} * 60)::INT || 'm ago' WHEN {sql.AGE} < 24 THEN trunc({sql.AGE})::INT || 'h ago' ELSE trunc({sql.AGE} / 24)::INT || 'd ago' END AS age FROM ne")
def age_text(spark, sf_dir):
    from ledeforge.functions.scoring import age_hours

    return _events(spark, sf_dir).select("seq", render.age_text(age_hours(views.now())).alias("age"))


@query(f"{_WITH} SELECT seq, CASE WHEN source_count <= 1 THEN '' WHEN source_count = 2 THEN '+1 outlet agrees' ELSE '+' || (source_count - 1) || ' outlets agree' END AS outlets FROM ne")
def outlets_text(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", render.outlets_text(F.col("source_count")).alias("outlets"))


@query(f"{_WITH} SELECT seq, strftime(published_at + INTERVAL 8 HOUR, '%d %b · %H:%M') AS shown FROM ne")
def local_time(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", render.local_time(F.col("published_at")).alias("shown"))


@query(f"{_SCORED} SELECT seq, repeat('█', round_even((score + 1e-9) * 20, 0)::INT) AS bar FROM sc")
def score_bar(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", render.score_bar(F.col("score") + TIE).alias("bar"))


# ---- rendered messages ----


def _ages():
    from ledeforge.functions.scoring import age_hours

    return age_hours(views.now())


def _explained(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("breakdown", breakdown(_W))


_DRIVEN = f"{_SCORED}, dr AS (SELECT *, {msql.drivers(_W)} AS fs FROM sc)"


@query(f"{_SELECTED} SELECT bucket, pick, {msql.entry('pick')} AS entry FROM sel")
def render_entries(spark, sf_dir):
    return _selected(spark, sf_dir).select("bucket", F.col("pick").cast("long").alias("pick"), render.entry(F.col("pick"), _ages()).alias("entry"))


@query(f"{_DRIVEN} SELECT seq, array_to_string(list_transform(fs, lambda f: {msql.why_line()}), chr(10)) AS why FROM dr")
def why_table(spark, sf_dir):
    return _factors(spark, sf_dir).select("seq", render.why_table(breakdown(_W)).alias("why"))


@query(f"{_DRIVEN}, pl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, seq) AS place FROM dr QUALIFY place <= 10), lw AS (SELECT *, {msql.LEAST} AS least FROM pl) SELECT source, place, seq, {msql.why('place')} AS text FROM lw")
def why_messages(spark, sf_dir):
    best = select.best_of(_explained(spark, sf_dir), ["source"], 10, "place")
    return best.select("source", F.col("place").cast("long").alias("place"), "seq", render.why_text(F.col("place"), _ages()).alias("text"))


@query(f"{_DRIVEN} SELECT seq, {msql.alert('0.68')} AS text FROM dr WHERE score >= 0.68")
def alert_messages(spark, sf_dir):
    due = _explained(spark, sf_dir).filter(F.col("score") >= 0.68)
    return due.select("seq", render.alert_text(_ages(), F.lit(0.68)).alias("text"))


@query(f"WITH {msql.READERS} SELECT chat_id, {msql.settings()} AS text FROM rd")
def settings_messages(spark, sf_dir):
    return views.readers(spark, sf_dir).select("chat_id", render.settings_text(F.col("categories"), F.col("depth"), {d: weights_for(d) for d in V.DEPTH_SPLITS}).alias("text"))


_SIGNED = f"{_FACT}, {msql.READERS}, {msql.ranked(_LO, _HI)}"


def _signed(spark, sf_dir):
    """(readers, signatures, ranked items, pools), the last two written, since every block of a view reads them."""
    readers, factors = views.readers(spark, sf_dir), _factors(spark, sf_dir)
    signs = materialize(signatures(readers), "signatures")
    lo, hi = ranking.limits(F.col("bucket"))
    ranked = materialize(rank_signatures(factors, signs, lo, hi), "signature-ranked")
    return readers, signs, ranked, materialize(signature_pools(factors, signs), "signature-pools")


@query(f"{_SIGNED} SELECT sign AS signature, rank, seq, bucket, pick, backfill, round(score + 1e-9, 6) AS score FROM rk")
def signature_ranking(spark, sf_dir):
    ranked = _signed(spark, sf_dir)[2]
    return ranked.select("signature", F.col("rank").cast("long").alias("rank"), "seq", "bucket", F.col("pick").cast("long").alias("pick"), "backfill", _r6(F.col("score") + TIE).alias("score"))


@query(f"{_SIGNED}, {msql.notes()}, {msql.sent(msql.top_blocks())}")
def top_messages(spark, sf_dir):
    readers, *of = _signed(spark, sf_dir)
    return messages.messages(messages.top_blocks(*of, views.now()), readers)


_NO_MARKET = "<i>market data unavailable</i>"


@query(f"{_SIGNED}, {msql.notes()}, {msql.sent(msql.digest_blocks(sql.q(_NO_MARKET)))}")
def digest_messages(spark, sf_dir):
    readers, signs, ranked, pools = _signed(spark, sf_dir)
    blocks = messages.digest_blocks(signs, ranked, pools, views.now(), F.lit(_NO_MARKET), ranking.digests(ranked, []))
    return messages.messages(blocks, readers)


def _first_model(prompt: str) -> str:
    """A model that fails for a third of prompts and answers another third without an object."""
    if len(prompt) % 3 == 0:
        raise RuntimeError("no answer")
    return "no object" if len(prompt) % 3 == 1 else '```json\n{"headline": " First view ", "bullets": ["up 7%", " "]}\n```'


def _second_model(prompt: str) -> str:
    return 'Here: {"headline": "Second view", "bullets": ["99.9 more"]}' if len(prompt) % 2 else '{"headline": " ", "bullets": []}'


_PROMPTS = f"""pi AS (SELECT sign, rank, title, source, rank || '. [' || bucket || '] [' || source || ']' || CASE WHEN source_count > 1 THEN ' [corroborated by ' || source_count || ' outlets]' ELSE '' END || ' (score ' || {msql.fixed('score', 2)} || ')' || chr(10) || '   TITLE: ' || title || chr(10) || '   SUMMARY: ' || CASE WHEN summary = '' THEN '(none provided)' ELSE substr(summary, 1, {V.PROMPT_SUMMARY_CHARS}) END AS p FROM rk),
pr AS (SELECT sign, string_agg(p, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE rank <= {V.DIGEST_BULLETS}) AS prompt, max(title) FILTER (WHERE rank = 1) AS lead_, string_agg(title || ' (' || source || ')', '|' ORDER BY rank) FILTER (WHERE rank <= {V.FALLBACK_BULLETS}) AS firsts FROM pi GROUP BY sign),
an AS (SELECT *, CASE WHEN length(prompt) % 3 = 2 THEN 1 WHEN length(prompt) % 2 = 1 THEN 2 ELSE 0 END AS said FROM pr),
wr AS (SELECT sign, prompt, said, CASE said WHEN 1 THEN 'First view' WHEN 2 THEN 'Second view' ELSE lead_ END AS headline, CASE said WHEN 1 THEN 'up 7%' WHEN 2 THEN '99.9 more' ELSE firsts END AS bullets FROM an)"""
_FIGURES = r"regexp_extract_all({0}, '(\d[\d,.]*\d|\d)', 1)"


@query(
    f"{_SIGNED}, {_PROMPTS} SELECT sign AS signature, length(prompt)::INT AS n_prompt, headline, bullets, said > 0 AS llm_ok, CASE said WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS model, CASE WHEN length(prompt) % 3 = 2 THEN '' ELSE 'first' END AS failed, array_to_string(list_filter({_FIGURES.format("headline || chr(10) || replace(bullets, '|', chr(10))")}, lambda x: NOT list_contains({_FIGURES.format('prompt')}, x)), ',') AS invented FROM wr"
)
def digest_chain(spark, sf_dir):
    ranked = _signed(spark, sf_dir)[2]
    made = ranking.digests(ranked, [("first", _first_model), ("second", _second_model)])
    sizes = ranking.digest_prompts(ranked, "signature").select("signature", F.length("prompt").alias("n_prompt"))
    return made.join(sizes, "signature").select("signature", "n_prompt", "headline", F.array_join("bullets", "|").alias("bullets"), "llm_ok", "model", F.array_join("failed", ",").alias("failed"), F.array_join("invented", ",").alias("invented"))


@query(f"SELECT doc_id, length(c)::INT AS n_chars, md5(c) AS md5 FROM (SELECT doc_id, CASE WHEN length(t) <= 4096 THEN t ELSE CASE WHEN contains(substr(t, 1, 4072), chr(10)) THEN regexp_extract(substr(t, 1, 4072), '(?s)^(.*)\\n', 1) ELSE substr(t, 1, 4072) END || {msql.text(chr(10) + chr(10) + '<i>…truncated</i>')} END AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def clip_messages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", render.clip(F.coalesce("text", F.lit(""))).alias("c"))
    return d.select("doc_id", F.length("c").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("md5"))


@query(f"SELECT doc_id, unnest(range(len(p)))::INT AS part, unnest(list_transform(p, lambda x: length(x)))::INT AS n_chars FROM (SELECT doc_id, {msql.split('t')} AS p FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents))")
def split_messages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = render.split_messages(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    return d.select("doc_id", F.posexplode(parts).alias("part", "text")).select("doc_id", "part", F.length("text").alias("n_chars"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"id": ' || doc_id || ', "n": [' || length(text) || ']}' WHEN 1 THEN '{"id": ' || doc_id || '}' WHEN 3 THEN '{"n": ' || length(text) || '}' END AS json FROM documents""")
def llm_json_extract(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.length("text").cast("string").alias("n"))
    form = F.pmod("doc_id", F.lit(4))
    said = F.when(form == 0, F.concat(F.lit('```json\n{"id": '), "id", F.lit(', "n": ['), "n", F.lit("]}\n```"))).when(form == 1, F.concat(F.lit('Sure: {"id": '), "id", F.lit("} as asked")))
    said = said.when(form == 2, F.concat(F.lit("no object {here "), "id")).otherwise(F.concat(F.lit('  {"n": '), "n", F.lit("}")))
    return d.select("doc_id", render.extract_json(said).alias("json"))


_POLL_CAP = 6
_LABEL = f"{sql.lst([f[0] for f in V.FEEDS])}[doc_id % {len(V.FEEDS)} + 1]"
_ENTRIES = f"""WITH en0 AS (
  SELECT doc_id, doc_id // {views.POLL_DOCS} AS poll, doc_id % {len(V.FEEDS)} AS feed, {_LABEL} AS source, {sql.lst([f[2] for f in V.FEEDS])}[doc_id % {len(V.FEEDS)} + 1] AS bucket, {[f[3] or V.WINDOW_HOURS for f in V.FEEDS]}[doc_id % {len(V.FEEDS)} + 1] AS window_h,
         trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], {sql.q(views.TITLE_CHARS)}, '', 'g')) AS title, upper(lang) AS tag,
         CASE WHEN doc_id % 13 = 0 THEN {sql.NOW} ELSE {sql.NOW} - to_minutes((doc_id * 7919 % 5000)::INT) END AS published_at FROM documents),
en1 AS (SELECT *, row_number() OVER (PARTITION BY poll, feed ORDER BY doc_id) - 1 AS entry_idx FROM en0 WHERE (poll + feed) % 11 <> 0),
en2 AS (SELECT *, {sql.REJECT} AS reject FROM en1 WHERE title <> '' AND doc_id % 17 <> 0 AND published_at >= {sql.NOW} - to_hours(window_h)),
en3 AS (SELECT *, coalesce(sum((reject IS NULL)::INT) OVER (PARTITION BY poll, source ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kb FROM en2),
en AS (SELECT *, feed * 1000000 + entry_idx AS seq FROM en3 WHERE kb < {_POLL_CAP})"""


def _polled(spark, sf_dir):
    from ledeforge.sources.feeds import feeds_table, parse_feeds

    bodies = views.feed_bodies(spark, sf_dir)
    return bodies, parse_feeds(bodies, feeds_table(spark), views.now(), _POLL_CAP)


@query(f"{_ENTRIES} SELECT poll, seq::BIGINT AS seq, title, source, lower(tag) || ',markets' AS tags, substr(trim(regexp_replace(title || ' & more', ' +', ' ', 'g')), 1, {V.SUMMARY_CHARS}) AS summary, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, reject FROM en")
def rss_parse(spark, sf_dir):
    return _polled(spark, sf_dir)[1].select("poll", "seq", "title", "source", F.array_join("tags", ",").alias("tags"), "summary", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "reject")


@query(f"{_ENTRIES} SELECT poll, feeds_total, feeds_total - len(failed) AS feeds_ok, array_to_string(failed, ',') AS feeds_failed, coalesce(items_kept, 0) AS items_kept FROM (SELECT poll, count(DISTINCT feed) AS feeds_total, list_sort(list_distinct(list(source) FILTER (WHERE (poll + feed) % 11 = 0))) AS failed FROM en0 GROUP BY poll) LEFT JOIN (SELECT poll, count(*) AS items_kept FROM en WHERE reject IS NULL GROUP BY poll) USING (poll)")
def feed_health(spark, sf_dir):
    health = stats.feed_stats(*_polled(spark, sf_dir), ["poll"])
    return health.withColumn("feeds_failed", F.array_join("feeds_failed", ",")).withColumn("feeds_ok", F.col("feeds_ok").cast("long"))


_MARKET = """WITH mk0 AS (SELECT c_custkey AS poll, c_custkey % 7 <> 0 AS fine, (c_custkey * 37 % 90000) + 0.5 AS btc, (c_custkey % 200 - 100) AS bc, c_custkey % 5 <> 0 AS has_eth, c_custkey * 11 % 5000 AS eth, (c_custkey % 30) + 0.31 AS ec, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 101 END AS fear FROM customer),
mk AS (SELECT * REPLACE (CASE WHEN bc < 0 THEN bc - 0.26 ELSE bc + 0.26 END AS bc) FROM mk0)"""


def _coin(sym: str, price: str, change: str) -> str:
    return f"'<b>{sym}</b>  $' || format('{{:,}}', round_even({price}::DOUBLE, 0)::BIGINT) || '  ' || CASE WHEN {change} >= 0 THEN '▲' ELSE '▼' END || ' ' || round(abs({change})::DECIMAL(18, 9), 1)::DECIMAL(18, 1) || '%'"


def _coin_prompt(sym: str, price: str, change: str) -> str:
    return f"'{sym} $' || format('{{:,.2f}}', {price}::DOUBLE) || ' (' || CASE WHEN {change} >= 0 THEN '+' ELSE '' END || {change}::DECIMAL(18, 2) || '% 24h)'"


_COINS = lambda f: f"list_filter([CASE WHEN fine AND has_eth THEN {f('ETH', 'eth', 'ec')} END, CASE WHEN fine THEN {f('BTC', 'btc', 'bc')} END], lambda x: x IS NOT NULL)"


@query(
    f"""{_MARKET} SELECT poll, CASE WHEN NOT fine AND fear IS NULL THEN '<i>market data unavailable</i>' ELSE array_to_string({_COINS(_coin)}, chr(10)) || CASE WHEN fear IS NULL THEN '' ELSE chr(10) || chr(10) || '<i>Fear &amp; Greed ' || fear || ' · Greed &amp; </i>' END END AS line,
CASE WHEN NOT fine AND fear IS NULL THEN '(market data unavailable this run)' ELSE array_to_string({_COINS(_coin_prompt)} || CASE WHEN fear IS NULL THEN []::VARCHAR[] ELSE ['Fear & Greed ' || fear || ' (Greed & )'] END, ' | ') END AS prompt FROM mk"""
)
def market_snapshot(spark, sf_dir):
    from ledeforge.sources import market

    polls = views.market_polls(spark, sf_dir)
    snap = market.market_snapshot(market.parse_tickers(polls.select("poll", F.col("tickers").alias("value"))), market.parse_mood(polls.select("poll", F.col("mood").alias("value"))), polls)
    of = (F.col("prices"), F.col("fear_greed"), F.col("fear_greed_label"))
    return snap.select("poll", render.market_line(*of).alias("line"), render.market_prompt(*of).alias("prompt"))


# ---- alerts ----

_MARKED = "https://example.com/s/7"


@query(f"{_SCORED} SELECT seq, round(score + 1e-9, 6) AS score FROM sc WHERE score >= 0.68 AND regexp_replace(string_split(url, '?')[1], '/+$', '') <> '{_MARKED}'")
def alert_batch(spark, sf_dir):
    marked = spark.createDataFrame([(_MARKED,)], "key string")
    return alerts.due_alerts(_scored(spark, sf_dir), marked, 0.68).select("seq", _r6(F.col("score") + TIE).alias("score"))


_FIRE = f"""WITH RECURSIVE ev AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value >= 50),
walk(user_id, k, event_id, last, fired) AS (
  SELECT user_id, k, event_id, ts, true FROM ev WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, e.event_id, CASE WHEN e.ts - w.last >= INTERVAL {V.ALERT_TTL_HOURS} HOUR THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL {V.ALERT_TTL_HOURS} HOUR
  FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id FROM walk WHERE fired"""


@query(_FIRE)
def alert_dedup_48h(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("value") >= 50).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return alerts.fire_once(e, "user_id", "ts", "event_id").select("user_id", "event_id")


# ---- the ranking cache ----

#: Chats of the cache query; each has many requests.
_CHATS = 10
_TRACE = f"""WITH RECURSIVE tr AS (
  SELECT user_id % {_CHATS} AS chat_id, event_id AS seq, ts, event_type = 'signup' AS change, CASE WHEN event_id % 5 = 0 THEN 'macro|data' ELSE 'flows,macro|balanced' END AS sig,
         row_number() OVER (PARTITION BY user_id % {_CHATS} ORDER BY ts, event_id) AS k FROM events),
walk(chat_id, k, seq, change, hit, sig, since) AS (
  SELECT chat_id, k, seq, change, false, CASE WHEN change THEN NULL ELSE sig END, CASE WHEN change THEN NULL ELSE ts END FROM tr WHERE k = 1
  UNION ALL
  SELECT e.chat_id, e.k, e.seq, e.change, h, CASE WHEN e.change THEN NULL WHEN h THEN w.sig ELSE e.sig END, CASE WHEN e.change THEN NULL WHEN h THEN w.since ELSE e.ts END
  FROM (SELECT e.*, w.sig AS wsig, w.since AS wat, coalesce(NOT e.change AND e.sig = w.sig AND e.ts - w.since < INTERVAL {V.CACHE_TTL_MINUTES} MINUTE, false) AS h FROM walk w JOIN tr e ON e.chat_id = w.chat_id AND e.k = w.k + 1) e,
       LATERAL (SELECT e.wsig AS sig, e.wat AS since) w)
SELECT chat_id, seq, hit FROM walk WHERE NOT change"""


@query(_TRACE)
def cache_hits(spark, sf_dir):
    from ledeforge.sources.ranking_cache import served

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % _CHATS).alias("chat_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    asked = e.filter("event_type <> 'signup'").select("chat_id", F.when(F.col("seq") % 5 == 0, "macro|data").otherwise("flows,macro|balanced").alias("signature"), "ts", "seq")
    return served(asked, e.filter("event_type = 'signup'")).select("chat_id", "seq", "hit")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
