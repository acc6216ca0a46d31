"""The eight factors, their weights and the breakdown, as column expressions.

``FACTORS`` is the registry: name to a function that gives (raw, reason) columns
over an items frame. Users may add factors of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V


def has(text: Column, pattern: str) -> Column:
    """Case-blind search with Unicode word rules."""
    return text.rlike("(?iU)" + pattern)


def any_of(text: Column, patterns: list[str]) -> Column:
    """One alternation, so each title is scanned once."""
    return has(text, "(?:" + "|".join(patterns) + ")")


def stems(tier: int) -> str:
    return r"\b(" + "|".join(sorted(V.KEYWORD_TIERS[tier])) + ")(?:" + "|".join(V.STEM_ENDINGS) + r")?\b"


def title_and_tags() -> Column:
    return F.concat(F.col("title"), F.lit(" "), F.array_join("tags", " "))


def keyword() -> tuple[Column, Column]:
    text = F.lower(title_and_tags())
    raw, reason = F.lit(0.0), F.lit("no tier keyword")
    for tier in sorted(V.KEYWORD_TIERS, reverse=True):
        hit = text.rlike("(?U)" + stems(tier))
        raw = F.when(hit, V.TIER_SCORES[tier]).otherwise(raw)
        reason = F.when(hit, F.concat(F.lit(f"tier {tier} '"), F.regexp_extract(text, "(?U)" + stems(tier), 1), F.lit("'"))).otherwise(reason)
    return raw, reason


def age_hours(now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros("published_at")) / F.lit(3.6e9)


def recency(now: Column) -> tuple[Column, Column]:
    age = F.greatest(F.lit(0.0), age_hours(now))
    return F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(float(V.WINDOW_HOURS))), F.format_string("%.1fh old", age)


def source_quality() -> tuple[Column, Column]:
    """A map literal of a dozen outlets; a join would cost an exchange node for nothing."""
    table = F.create_map(*(F.lit(x) for kv in V.SOURCE_QUALITY.items() for x in kv))
    known = F.try_element_at(table, F.coalesce("source", F.lit("")))
    return F.coalesce(known, F.lit(V.DEFAULT_QUALITY)), F.when(known.isNull(), F.concat("source", F.lit(" (unrated)"))).otherwise(F.col("source"))


def topicality() -> tuple[Column, Column]:
    tags = F.array_distinct(F.transform(F.filter("tags", lambda t: t != ""), lambda t: F.replace(F.lower(t), F.lit("_"), F.lit("-"))))
    good = F.array_intersect(tags, F.array(*map(F.lit, V.RELEVANT_TAGS)))
    bad = F.array_intersect(tags, F.array(*map(F.lit, V.OFFTOPIC_TAGS)))
    raw = F.when(F.size(tags) == 0, 0.5).when(F.size(good) > 0, 1.0).when(F.size(bad) > 0, 0.0).otherwise(0.5)
    named = lambda kind, c: F.concat(F.lit(f"{kind} tag '"), F.array_min(c), F.lit("'"))
    reason = F.when(F.size(tags) == 0, "no tags (neutral)").when(F.size(good) > 0, named("relevant", good)).when(F.size(bad) > 0, named("off-topic", bad)).otherwise("tags present but unmapped")
    return raw, reason


def source_count() -> tuple[Column, Column]:
    n = F.col("source_count")
    raw = F.when(n == 1, 0.0).when(n == 2, 0.20).when(n <= 4, 0.55).otherwise(1.0)
    text = F.concat(n.cast("string"), F.lit(" sources"))
    return raw, F.when(n == 1, "single source").when(n <= 4, text).otherwise(F.concat(text, F.lit(" (saturated)")))


def numeric() -> tuple[Column, Column]:
    pattern = F.lit("(?iU)" + V.FIGURE)
    n = F.regexp_count("title", pattern)
    first = F.trim(F.regexp_extract("title", "(?iU)(" + V.FIGURE + ")", 1))
    reason = F.when(n == 0, "no figure in headline").when(n == 1, F.concat(F.lit("one figure ("), first, F.lit(")"))).when(n == 2, "two figures").otherwise(F.concat(n.cast("string"), F.lit(" figures")))
    return F.when(n == 0, 0.0).when(n == 1, 0.35).when(n == 2, 0.75).otherwise(1.0), reason


def analysis() -> tuple[Column, Column]:
    title = F.col("title")
    framing = has(title, V.FRAMING)
    view = has(title, V.ATTRIBUTION) | title.rlike("(?U)" + V.COLON_SOURCE)
    long_ = F.length(F.coalesce("summary", F.lit(""))) > V.LONG_SUMMARY
    points = F.when(framing, 0.45).otherwise(0.0) + F.when(view, 0.40).otherwise(0.0) + F.when(long_, 0.15).otherwise(0.0)
    said = F.concat_ws(", ", F.when(framing, "framing"), F.when(view, "attributed view"), F.when(long_, "long summary"))
    return F.least(F.lit(1.0), points), F.when(said == "", "straight report").otherwise(said)


def asset() -> tuple[Column, Column]:
    raw, reason = F.lit(0.5), F.lit("no specific asset")
    for score, pattern, text in reversed(V.ASSETS):
        hit = has(F.col("title"), pattern)
        raw, reason = F.when(hit, score).otherwise(raw), F.when(hit, text).otherwise(reason)
    return raw, reason


#: name -> function of the frozen ``now``
FACTORS: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "keyword": lambda now: keyword(),
    "recency": recency,
    "source_quality": lambda now: source_quality(),
    "topicality": lambda now: topicality(),
    "source_count": lambda now: source_count(),
    "numeric": lambda now: numeric(),
    "analysis": lambda now: analysis(),
    "asset": lambda now: asset(),
}


def primary_subject(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(V.SUBJECTS):
        out = F.when(has(title, pattern), name).otherwise(out)
    return out


def classify(text: Column) -> Column:
    """The first category in priority order, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(V.CATEGORIES):
        out = F.when(has(text, V.any_word(*V.CATEGORY_WORDS[name])), name).otherwise(out)
    return out


def weights_for(depth: str = "balanced") -> dict[str, float]:
    """The factor table of a reader; an unknown depth is balanced."""
    numeric_, analysis_ = V.DEPTH_SPLITS.get(depth, V.DEPTH_SPLITS["balanced"])
    return V.FACTOR_WEIGHTS | {"numeric": numeric_, "analysis": analysis_}


def with_factors(items: DataFrame, now: Column, names: list[str] | None = None) -> DataFrame:
    """Adds ``raw_<name>`` and ``why_<name>`` for each factor; computed once, they serve any number of readers."""
    cols = {}
    for name in names or list(FACTORS):
        raw, reason = FACTORS[name](now)
        cols |= {f"raw_{name}": raw.cast("double"), f"why_{name}": reason}
    return items.withColumns(cols)


def total(weights: Mapping[str, float]) -> Column:
    """Weighted mean of the raw factors, added in table order; unknown names are an error."""
    weights = weights or V.FACTOR_WEIGHTS
    for name in weights:
        if name not in FACTORS:
            raise KeyError(name)
    score = F.lit(0.0)
    for name, w in weights.items():
        score = score + F.lit(w) * F.col(f"raw_{name}")
    # the sum that the SQL divides by; added step by step it can be another float, which moves scores across the threshold
    return score / F.lit(float(sum(weights.values())))


def breakdown(weights: Mapping[str, float]) -> Column:
    weights = weights or V.FACTOR_WEIGHTS
    return F.array(
        *(
            F.struct(F.lit(n).alias("name"), F.col(f"raw_{n}").alias("raw"), F.lit(w).alias("weight"), F.col(f"why_{n}").alias("reason"), (F.col(f"raw_{n}") * F.lit(w)).alias("contribution"), F.lit(k).alias("ord"))
            for k, (n, w) in enumerate(weights.items())
        )
    )


def score_items(items: DataFrame, now: Column, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds ``score`` and ``breakdown`` under a weight table."""
    weights = weights or V.FACTOR_WEIGHTS
    scored = with_factors(items, now, list(weights))
    return scored.withColumn("score", total(weights)).withColumn("breakdown", breakdown(weights)).drop(*(f"{p}_{n}" for n in weights for p in ("raw", "why")))


def top_drivers(factors: Column, n: int) -> Column:
    """The ``n`` largest contributions; ties keep table order."""
    ranked = F.array_sort(factors, lambda x, y: F.when(x["contribution"] > y["contribution"], -1).when(x["contribution"] < y["contribution"], 1).when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0))
    return F.slice(ranked, 1, n)


def weakest(factors: Column) -> Column:
    """The first of the smallest contributions."""
    return F.get(F.array_sort(F.transform(factors, lambda f: F.struct(f["contribution"].alias("c"), f["ord"].alias("o"), f["name"].alias("name")))), F.lit(0))["name"]
