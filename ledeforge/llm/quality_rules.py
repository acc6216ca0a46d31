"""Quality rules with thresholds that adapt to each language and source.

Base statistics are column expressions over the whole text. Thresholds come
from mergeable quantile sketches (KLL) of the documents that pass the fixed base
rule, per (lang, source), with the language and then the whole corpus, merged
from the same sketches, standing in for groups too small to have quantiles. They are joined back to the statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.text import lines, strip_ws, words
from ledeforge.runtime import materialize

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Size of a quantile sketch: exact up to so many documents, and a rank error of about 1 in 2,000 beyond.
SKETCH = 4096
#: Parts in which the sketches of one group's tasks meet first.
SPREAD = 64
#: Groups with fewer documents that pass the base rule take the thresholds of the next wider group; quartiles of fewer say little.
MIN_GROUP = 20
#: Fences lie this many quartile ranges, and at least the margin, beyond the quartiles.
FENCE = 4
#: The judged ratios in thousandths, with the least distance of their fences from the quartiles; None: no fence there.
RATIOS = {"word_len": (2000, 3000), "symbols": (None, 100), "dup_lines": (None, 300), "repeats": (None, 100)}


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) to ``docs``.

    Null text has no words and one empty line, so all five are 0. A word counts
    as repeated if any window of five words that covers it occurs twice or more
    in the text, the first occurrence included. Windows are told apart by 64-bit
    hashes within one text.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    base = docs.select(row, text.alias("t"), words(F.col(text_col)).alias("w"))
    worded = F.filter(lines(F.col("t")), lambda x: strip_ws(x) != "")
    hashed = base.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # only texts with a repeat go on to sort their windows
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    sorted_ = hashed.select("row", *new[:4], pairs.alias("p"))
    same = lambda i, j: F.get("p", i)["h"] == F.get("p", j)["h"]
    twice = F.filter("p", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    at = sorted_.select("row", *new[:4], F.array_sort(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return at.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *new[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(n_words="n_words", n_repeat="n_repeat_words"):
    return (F.col(n_words) < MIN_WORDS) | (F.lit(100) * F.col(n_repeat) > F.lit(MAX_REPEAT_PERCENT) * F.col(n_words))


def ratios() -> dict:
    """The judged ratios as integers in thousandths, so any engine has them alike."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda c: F.floor(F.lit(1000) * F.col(c) / n).cast("long")
    return {"word_len": per("word_chars"), "symbols": per("n_symbols"), "dup_lines": per("n_dup_lines"), "repeats": per("n_repeat_words")}


def thresholds(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """(level, g_lang, g_source, n, lo_*, hi_*) for each group, each language and the whole.

    Each task sketches its own rows of a group; the sketches of a large group
    meet in ``SPREAD`` parts before they are one, and languages and the whole
    merge what the groups below them have.
    """
    names = [f"k_{name}" for name in RATIOS]
    merged = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_bigint(k, F.lit(SKETCH)).alias(k) for k in names))
    part = F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("part")
    own = stats.groupBy(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), part).agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_bigint(name, F.lit(SKETCH)).alias(f"k_{name}") for name in RATIOS))
    groups = materialize(merged(own, "g_lang", "g_source"), "quality-sketches")
    by_lang = merged(groups, "g_lang").withColumn("g_source", F.lit(None).cast("string"))
    whole = merged(groups.withColumn("g_lang", F.lit(None).cast("string")), "g_lang").withColumn("g_source", F.lit(None).cast("string"))
    cols = ["level", "g_lang", "g_source", "n", *names]
    levels = groups.withColumn("level", F.lit(2)).select(cols).union(by_lang.withColumn("level", F.lit(1)).select(cols)).union(whole.withColumn("level", F.lit(0)).select(cols))
    made = levels.select("level", "g_lang", "g_source", "n", *(F.kll_sketch_get_quantile_bigint(f"k_{name}", F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{name}") for name in RATIOS))
    out = [F.col(c) for c in ("level", "g_lang", "g_source", "n")]
    for name, (low, high) in RATIOS.items():
        q1, q3 = F.get(f"q_{name}", F.lit(0)), F.get(f"q_{name}", F.lit(1))
        spread = (q3 - q1) * FENCE
        out.append((q1 - F.greatest(spread, F.lit(low)) if low is not None else F.lit(None)).cast("long").alias(f"lo_{name}"))
        out.append((q3 + F.greatest(spread, F.lit(high))).cast("long").alias(f"hi_{name}"))
    return made.select(*out)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """Adds the five statistics, ``base_failed`` and ``kept`` to every row; drops the text.

    ``kept`` is false where the base rule fails, and else says whether every
    ratio lies within the fences of the row's group: its (lang, source) if
    ``min_group`` of its documents pass the base rule, else its language by the
    same count, else the whole. Null languages and sources
    are groups of their own. Repeated rows are documents of their own.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    keep = [c for c in docs.columns if c != text_col and c not in new]
    slim = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(lang_col).cast("string").alias("lang_"), F.col(source_col).cast("string").alias("source_"), F.col(text_col).alias("text_"))
    stats = text_stats(slim, "text_").drop("text_").withColumn("base_failed", base_failed())
    stats = materialize(stats.withColumns(ratios()), "quality-stats")
    fences = materialize(thresholds(stats.filter(~F.col("base_failed")), "lang_", "source_"), "quality-fences")
    bounds = [f"{s}_{n}" for n in RATIOS for s in ("lo", "hi")]

    def level(k: int):
        return fences.filter((F.col("level") == k) & (F.col("n") >= (min_group if k else 0))).select("g_lang", "g_source", F.struct(*bounds).alias(f"b{k}"))

    g2, g1, g0 = level(2), level(1).drop("g_source"), level(0).select("b0")
    found = stats.join(g2, F.col("lang_").eqNullSafe(g2["g_lang"]) & F.col("source_").eqNullSafe(g2["g_source"]), "left").drop("g_lang", "g_source")
    found = found.join(g1, F.col("lang_").eqNullSafe(g1["g_lang"]), "left").drop("g_lang")
    found = found.join(F.broadcast(g0), F.lit(True), "left")  # one row
    b = F.coalesce("b2", "b1", "b0")
    inside = F.lit(True)
    for name in RATIOS:
        inside = inside & F.coalesce(F.col(name) >= b.getField(f"lo_{name}"), F.lit(True)) & F.coalesce(F.col(name) <= b.getField(f"hi_{name}"), F.lit(True))
    return found.select(*(F.col("row").getField(c).alias(c) for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
