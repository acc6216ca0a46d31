"""Story dedupe within a batch and bucket: three detectors, components, merge.

Each detector needs a shared term or entity, so the pairwise comparison is an
equi-join of exploded terms. Only the rarest terms that any linked pair must
share are joined, so a term of every headline makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.functions.text import content_tokens, entity_tokens, normal_tokens
from ledeforge.operators.graph import connected_components
from ledeforge.runtime import materialize


def _grams(items: DataFrame) -> DataFrame:
    """(batch, seq, term) of unigrams and bigrams of title and tags; terms have two characters or more."""
    tokens = items.select("batch", "seq", F.filter(normal_tokens(F.concat("title", F.lit(" "), F.array_join("tags", " "))), lambda t: F.length(t) >= 2).alias("t"))
    pairs = F.when(F.size("t") >= 2, F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat(F.get("t", i), F.lit(" "), F.get("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    return tokens.select("batch", "seq", F.explode(F.concat("t", pairs)).alias("term"))


def tfidf(items: DataFrame, max_features: int = V.MAX_FEATURES) -> DataFrame:
    """(batch, seq, term, w): smoothed, L2-normalised weights over each batch's most frequent terms, ties by term."""
    tf = _grams(items).groupBy("batch", "seq", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = tf.groupBy("batch", "term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("cf"), "term"))
    vocabulary = vocabulary.withColumn("r", rank).filter(F.col("r") <= max_features)
    n = items.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    idf = vocabulary.join(n, "batch").select("batch", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, ["batch", "term"]).withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("batch", "seq")))
    return raw.select("batch", "seq", "term", (F.col("x") / norm).alias("w"))


def edges_cosine(items: DataFrame, threshold: float = V.DEDUPE_THRESHOLD) -> DataFrame:
    """(batch, a, b, cosine) of pairs at or above a positive ``threshold``."""
    if threshold <= 0:
        raise ValueError("at a threshold of 0 every pair would link, with or without a shared term")
    w = materialize(tfidf(items), "tfidf")
    # unit vectors that share only terms with so little of a vector's length can't reach the threshold; all are cut in one order, the rarest terms first
    df = w.groupBy("batch", "term").agg(F.count(F.lit(1)).alias("df"))
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("batch", "seq").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0))
    keys = w.join(df, ["batch", "term"]).withColumn("rest", rest).filter(F.sqrt("rest") >= threshold - 1e-6).select("batch", "term", "seq")
    met = keys.withColumnRenamed("seq", "a").join(keys.withColumnRenamed("seq", "b"), ["batch", "term"]).filter(F.col("a") < F.col("b")).select("batch", "a", "b").distinct()
    # a title's vector is one cell, so a pair costs two look-ups of rows and no shuffle of its terms
    vectors = w.groupBy("batch", "seq").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")).alias("v"))
    vectors = materialize(vectors.withColumn("v", F.array_sort("v")), "vectors")
    side = lambda x: vectors.select("batch", F.col("seq").alias(x), F.col("v").alias(f"v{x}"))
    both = met.join(side("a"), ["batch", "a"]).join(side("b"), ["batch", "b"]).withColumn("mb", F.map_from_entries("vb"))
    product = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(F.col("mb"), x["t"]), F.lit(0.0)))
    # sums of floats depend on their order in the last digits
    return both.select("batch", "a", "b", product.alias("cosine")).filter(F.round("cosine", 9) >= threshold)


def with_entities(items: DataFrame) -> DataFrame:
    return items.select("batch", "seq", entity_tokens(F.col("title")).alias("ents"), content_tokens(F.col("title")).alias("content"))


def entity_df(items: DataFrame) -> DataFrame:
    """(batch, entity, df)."""
    return with_entities(items).select("batch", F.explode("ents").alias("entity")).groupBy("batch", "entity").agg(F.count(F.lit(1)).alias("df"))


def rarity_ceiling(n):
    """Headlines an entity may appear in and still be rare, in a batch of ``n``."""
    return F.greatest(F.lit(2), F.least(F.lit(V.RARE_MAX), F.floor(n * F.lit(V.RARE_SHARE)).cast("int")))


def _generic():
    return F.array(*map(F.lit, V.GENERIC_ENTITIES))


def _sharing(e: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs that meet in ``keys`` (batch, seq, entity) and share an entity that isn't generic, with both sides' sets."""
    pairs = keys.select("batch", "entity", F.col("seq").alias("a")).join(keys.select("batch", "entity", F.col("seq").alias("b")), ["batch", "entity"]).filter(F.col("a") < F.col("b")).select("batch", "a", "b").distinct()
    left = e.select("batch", F.col("seq").alias("a"), F.col("ents").alias("ea"), F.col("content").alias("ca"))
    right = e.select("batch", F.col("seq").alias("b"), F.col("ents").alias("eb"), F.col("content").alias("cb"))
    met = pairs.join(left, ["batch", "a"]).join(right, ["batch", "b"]).withColumn("shared", F.array_intersect("ea", "eb"))
    return met.withColumn("named", F.array_except("shared", _generic())).filter(F.size("named") > 0)


def edges_same_event(items: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """(batch, a, b): two entities or more shared, not all generic, and at least half of all.

    Sets that share half of all have one of their rarer halves' entities in
    common, so only those are joined.
    """
    e = materialize(with_entities(items), "entities") if e is None else e
    each = e.select("batch", "seq", F.size("ents").alias("m"), F.explode("ents").alias("entity"))
    df = each.groupBy("batch", "entity").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("batch", "seq").orderBy("df", "entity"))
    keys = each.join(df, ["batch", "entity"]).withColumn("place", place).filter(F.col("place") <= F.col("m") - F.ceil(F.col("m") / 2) + 1).select("batch", "seq", "entity")
    return _sharing(e, keys).filter((F.size("shared") >= 2) & (F.size("shared") / F.size(F.array_union("ea", "eb")) >= 0.5)).select("batch", "a", "b")


def edges_rare(items: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """(batch, a, b): every shared entity that isn't generic is rare, and a content word beyond them is shared.

    Such pairs share a rare entity, so only rare ones are joined, in lists no longer than the ceiling.
    """
    e = materialize(with_entities(items), "entities") if e is None else e
    n = e.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).select("batch", rarity_ceiling(F.col("n")).alias("ceiling"))
    each = e.select("batch", "seq", F.explode(F.array_except("ents", _generic())).alias("entity"))
    rare = each.groupBy("batch", "entity").agg(F.count(F.lit(1)).alias("df")).join(n, "batch").filter(F.col("df") <= F.col("ceiling")).select("batch", "entity")
    keys = each.join(rare, ["batch", "entity"])
    own = keys.groupBy("batch", "seq").agg(F.collect_set("entity").alias("rare"))
    pairs = _sharing(e, keys).join(own.withColumnRenamed("seq", "a"), ["batch", "a"])
    word = F.size(F.array_except(F.array_intersect("ca", "cb"), F.col("named"))) > 0
    return pairs.filter((F.size(F.array_except("named", "rare")) == 0) & word).select("batch", "a", "b")


def clusters(items: DataFrame, threshold: float = V.DEDUPE_THRESHOLD) -> DataFrame:
    """(batch, seq, cluster): the smallest seq that any detector's edges reach. ``seq`` is unique."""
    e = materialize(with_entities(items), "entities")
    edges = edges_cosine(items, threshold).select("a", "b").union(edges_same_event(items, e).select("a", "b")).union(edges_rare(items, e).select("a", "b"))
    comps = connected_components(edges)
    return items.select("batch", "seq").join(comps.withColumnRenamed("node", "seq"), "seq", "left").select("batch", "seq", F.coalesce("component", "seq").alias("cluster"))


def merge(items: DataFrame, members: DataFrame) -> DataFrame:
    """One row a cluster: its first item, with the outlets and tags of all where there is more than one."""
    rows = items.join(members.select("seq", "cluster"), "seq")
    keep = [c for c in items.columns if c not in ("source_count", "merged_sources", "tags")]
    made = rows.groupBy("batch", "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(*keep, "tags"), "seq").alias("first"),
        F.count_distinct("source").alias("outlets"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("all_tags"),
    )
    many = F.col("n") > 1
    return made.select(
        *(F.col("first").getField(c).alias(c) for c in keep),
        F.when(many, F.col("all_tags")).otherwise(F.col("first.tags")).alias("tags"),
        F.when(many, F.col("outlets")).otherwise(1).cast("int").alias("source_count"),
        F.when(many, F.col("sources")).otherwise(F.array().cast("array<string>")).alias("merged_sources"),
    )


def dedupe(items: DataFrame, threshold: float = V.DEDUPE_THRESHOLD) -> DataFrame:
    """Collapses items (batch, seq, title, tags, source, ...) to one row a story."""
    return merge(items, clusters(items, threshold))
