"""URL filters by association rules.

A URL is a set of tokens. Spark's FP-growth mines token sets of labelled URLs
together with their label; sets that imply the bad label with enough support and
confidence become rules, of which only the minimal ones stay.

Mining is over closed tokens, or k pieces of one path would make 2^k frequent
sets: tokens of the very same labelled pages are one class, of which a URL needs
any member. A class that is a rule by itself, which its two counts tell, is in no
other minimal rule and leaves the baskets. FP-growth combines what is left of
pages with up to ``MAX_CLASSES`` classes; sets that stand on longer pages are
mined level by level, with counts of all pages, so no class of a page is left out.

Rules match through an inverted index: a rule is filed under the tokens of its
rarest class, and a URL's tokens look up the rules whose other classes are then
checked. Rules given by host and path go first, the longest that fits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.text import LOWER, UPPER
from ledeforge.runtime import bounded_broadcast, materialize, release

#: (verdict, host, path): fixed values of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.002
MIN_PAGES = 5
MIN_CONFIDENCE = 0.5
#: Token sets that rules match, up to which their join is a broadcast.
HIT_KINDS = 200_000
BAD = "label=bad"
#: Token classes up to which FP-growth takes a page, since it makes all their sets; what stands on longer pages is mined level by level.
MAX_CLASSES = 12
MINED = "items array<array<string>>, n_items int, anchor string, confidence double"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both are empty for null and for URLs without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Scheme, every domain suffix, every host label but the last two (the only one of a short host), every path piece by its place, the file ending, every query key and a fragment mark. Digits runs in paths are ``0``."""
    u = F.coalesce(url, F.lit(""))
    host, path = url_parts(url)
    pieces = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    keys = F.array_distinct(F.regexp_extract_all(u, F.lit("[?&]([^=&#]+)"), F.lit(1)))
    labels = F.split(host, "\\.")
    n = F.size(labels)
    named = lambda name, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(name + "="), x))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    mark = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(name + "="), c))
    tokens = F.array(
        mark("scheme", F.regexp_extract(u, "^([A-Za-z]+)://", 1)),
        mark("ending", F.regexp_extract(path, "\\.([A-Za-z]+)$", 1)),
        F.when(F.instr(u, "#") > 0, F.lit("fragment")),
    )
    placed = F.transform(pieces, lambda x, k: F.concat(F.lit("path"), k.cast("string"), F.lit("="), x))
    return F.array_distinct(F.concat(F.array_compact(tokens), named("domain", suffixes), named("label", F.slice(labels, 1, F.greatest(n - 2, F.lit(1)))), placed, named("key", keys)))


def _classes(baskets: DataFrame, least: int) -> DataFrame:
    """(name, tokens, n, n_bad): the tokens of ``least`` bad pages or more, those of the same pages as one class."""
    each = baskets.select("row", "bad", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "row")).alias(f"s{seed}") for seed in (1, 2)]
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *same).filter(F.col("n_bad") >= least)
    # a class has the tokens of one URL at most
    return counts.groupBy("n", "n_bad", "s1", "s2").agg(F.min("token").alias("name"), F.sort_array(F.collect_list("token")).alias("tokens")).select("name", "tokens", "n", "n_bad")


def _deep_rules(pages: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """(names, confidence): minimal rules of several classes, as far as they stand on a long page of ``pages`` (row, bad, long, names), counted on all.

    Level by level. A minimal rule has no part on the very same pages, nor has
    any part of it, so sets that have one are passed over; pieces that lie within
    each other make pairs and nothing longer.
    """
    spark = pages.sparkSession
    found = spark.createDataFrame([], "names array<string>, confidence double")
    marks = pages.select("row", "bad", "long")
    on = materialize(pages.select("row", F.explode("names").alias("name")).select("row", F.array("name").alias("names")), "url-level")
    while True:
        sets = on.join(marks, "row").groupBy("names").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.count_if("long").alias("n_long"))
        sets = sets.filter((F.col("n_bad") >= least) & (F.col("n_long") > 0))
        if "bound" in on.columns:
            sets = sets.join(on.select("names", "bound").distinct(), "names").filter(F.col("n") < F.col("bound")).drop("bound")
        sets = materialize(sets, "url-sets")
        sure = F.col("n_bad") >= F.lit(min_confidence) * F.col("n")
        found = found.unionByName(sets.filter(sure).select("names", (F.col("n_bad") / F.col("n")).alias("confidence")))
        kept = sets.filter(~sure).select("names", "n")
        size = F.size("names")
        ended = kept.select("names", F.slice("names", 1, size - 1).alias("head"), F.element_at("names", -1).alias("last"))
        # two sets that differ in their last class make a larger one, whose every part must have been kept
        wider = ended.join(ended.select("head", F.col("last").alias("next")), "head").filter(F.col("last") < F.col("next")).select("names", F.array_append("names", F.col("next")).alias("whole"))
        parts = wider.select("whole", F.explode(F.transform("whole", lambda x: F.array_remove("whole", x))).alias("names"))
        bounds = parts.join(kept, "names").groupBy("whole").agg(F.min("n").alias("bound"), F.count(F.lit(1)).alias("g")).filter(F.col("g") == F.size("whole")).select("whole", "bound")
        wider = materialize(wider.join(bounds, "whole"), "url-wider")
        if wider.isEmpty():
            return found
        held = pages.select("row", F.col("names").alias("all"))
        grown = on.select("row", "names").join(wider, "names").join(held, "row").filter(F.array_contains("all", F.element_at("whole", -1)))
        on = materialize(grown.select("row", F.col("whole").alias("names"), "bound"), "url-level")


def _combined(baskets: DataFrame, classes: DataFrame, least: int, min_confidence: float, max_classes: int) -> DataFrame:
    """(names, confidence): sets of classes that imply the label, only minimal ones; by FP-growth, and level by level where they stand on a page of more than ``max_classes``."""
    spark = baskets.sparkSession
    of = bounded_broadcast(classes.select("name", "n", F.explode("tokens").alias("token")))
    held = baskets.select("row", "bad", F.explode("tokens").alias("token")).join(of, "token").select("row", "bad", "name").distinct()
    named = held.groupBy("row", "bad").agg(F.array_sort(F.collect_list("name")).alias("names"))
    paged = materialize(named.withColumn("long", F.size("names") > max_classes), "url-baskets")
    short, long_ = paged.filter(~F.col("long")), paged.filter("long")
    rules = spark.createDataFrame([], "names array<string>, confidence double")
    n = short.count()
    if n >= least:
        items = short.select(F.when(F.col("bad"), F.array_append("names", BAD)).otherwise(F.col("names")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(items)
        grown = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("names"), "confidence")
        rules = materialize(grown.filter(F.size("names") > 1), "url-rules")
    if not long_.isEmpty():
        # sets that long pages have are counted with these
        at = long_.select("names").distinct().select(F.col("names").alias("all"), F.explode("names").alias("first"))
        met = rules.withColumn("first", F.get("names", F.lit(0))).join(at, "first").filter(F.size(F.array_except("names", "all")) == 0).select("names").distinct()
        rules = materialize(rules.join(met, "names", "left_anti").unionByName(_deep_rules(paged, least, min_confidence).filter(F.size("names") > 1)), "url-rules")
    release(paged)
    part = rules.select(F.col("names").alias("p_names"), F.size("names").alias("p_n"), F.get("names", F.lit(0)).alias("p_first"))
    wider = rules.select("names", F.size("names").alias("n"), F.explode("names").alias("name")).join(part, (F.col("name") == F.col("p_first")) & (F.col("p_n") < F.col("n"))).filter(F.size(F.array_except("p_names", "names")) == 0)
    return rules.join(wider.select("names").distinct(), "names", "left_anti")


def mine_rules(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, max_classes: int = MAX_CLASSES) -> DataFrame:
    """(items, n_items, anchor, confidence): sets of token classes that imply a bad label, a row for each token that a rule is filed under.

    A page is bad if any of its labels is 0; null labels are left out. Without
    labelled pages, or bad ones, there are no rules. A set needs ``min_support``
    of the labelled pages and ``min_pages`` of them, bad ones alone counted.
    Pages that repeat an id count as often as they stand there.
    """
    spark = pages.sparkSession
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg((F.min(label_col) == 0).alias("bad"))
    baskets = pages.select(F.col(id_col).alias("_id"), url_tokens(F.col(url_col)).alias("tokens")).join(marks, "_id")
    baskets = materialize(baskets.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "url-pages")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], MINED)
    least = max(1, math.ceil(max(min_support * n, min(n, min_pages)) - 1e-9))
    classes = materialize(_classes(baskets, least), "url-classes")
    sure = F.col("n_bad") >= F.lit(min_confidence) * F.col("n")
    single = classes.filter(sure).select(F.array("name").alias("names"), (F.col("n_bad") / F.col("n")).alias("confidence"))
    rules = materialize(single.unionByName(_combined(baskets, classes.filter(~sure), least, min_confidence, max_classes)), "url-minimal")
    whole = rules.select("names", "confidence", F.explode("names").alias("name")).join(classes.select("name", "tokens", "n"), "name")
    rarest = F.min_by("tokens", F.struct("n", "name"))
    filed = whole.groupBy("names", "confidence").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "tokens"))), lambda c: c["tokens"]).alias("items"), rarest.alias("anchors"))
    return materialize(filed.select("items", F.size("items").alias("n_items"), F.explode("anchors").alias("anchor"), "confidence"), "url-mined")


def filter_urls(pages: DataFrame, mined: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    A given rule fits its host and all subdomains where the path starts with
    its path; the longest of host and path wins, the first among equals. Where
    none fits, ``rule`` is null and the verdict is ``block`` if a mined rule
    matches, else ``allow``; so null and malformed URLs are allowed. The four
    names are replaced where the input has them. Repeated rows are judged each;
    an empty table stays empty, and without mined rules the given ones decide.
    """
    host, path = url_parts(F.col(url_col))
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in new]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), host.alias("host"), path.alias("path"), url_tokens(F.col(url_col)).alias("tokens"))
    kinds = rows.select("tokens").distinct()
    hit = kinds.select("tokens", F.explode("tokens").alias("token")).join(mined, F.col("token") == F.col("anchor")).filter(F.forall("items", lambda c: F.arrays_overlap(c, F.col("tokens")))).select("tokens").distinct().withColumn("bad", F.lit(True))
    # written first, so that a token set of very many pages is looked up where they are, or split
    hit = bounded_broadcast(materialize(hit, "url-hits"), HIT_KINDS)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    judged = rows.join(hit, "tokens", "left")
    return judged.select(*(F.col("row").getField(c).alias(c) for c in keep), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise("allow")).alias("verdict"))
