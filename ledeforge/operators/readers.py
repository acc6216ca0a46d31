"""Rankings for very many readers, by what they have in common.

A ranking depends on a reader's categories and depth alone, their signature, of
which there are fewer than a hundred. So items are scored once for each depth and
cut to the few of each category and subject that any selection can reach; those
meet the signatures, and readers meet the results of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import total, weights_for
from ledeforge.operators.select import MOST, best_of, select_top


def signature(categories: Column, depth: Column) -> Column:
    """What a ranking depends on, as text: sorted categories and depth."""
    return F.concat(F.array_join(F.sort_array(categories), ","), F.lit("|"), depth)


def signatures(readers: DataFrame) -> DataFrame:
    """(signature, categories, depth) of ``readers`` (chat_id, categories, depth), each once."""
    return readers.groupBy(signature(F.col("categories"), F.col("depth")).alias("signature")).agg(F.first("categories").alias("categories"), F.first("depth").alias("depth"))


def depth_scores(factors: DataFrame) -> DataFrame:
    """``factors`` once for each depth, with ``depth`` and ``score``."""
    each = F.array(*(F.struct(F.lit(d).alias("depth"), total(weights_for(d)).alias("score")) for d in V.DEPTH_SPLITS))
    return factors.withColumn("_d", F.explode(each)).select("*", "_d.depth", "_d.score").drop("_d")


def reachable(scored: DataFrame, bucket: str = "bucket") -> DataFrame:
    """The items that a selection over any set of categories can reach: the first few of each depth, bucket, category and subject."""
    return best_of(scored, ["depth", bucket, "category", "subject"], V.MAX_PER_SUBJECT + MOST, "_n").drop("_n")


def rank_signatures(factors: DataFrame, signs: DataFrame, lo: Column, hi: Column, bucket: str = "bucket") -> DataFrame:
    """The selected items of every signature, ``rank`` from 1 over all buckets by score, crypto before macro, then ``seq``; with ``pick`` and ``backfill`` within the bucket.

    ``factors`` has raw factors, category and subject; ``lo`` and ``hi`` bound a
    bucket's items. A signature of all categories takes items without one too.
    """
    few = reachable(depth_scores(factors), bucket)
    full = F.size("categories") == len(V.CATEGORIES)
    wants = signs.select("signature", "depth", F.explode(F.when(full, F.array(F.lit("*"))).otherwise(F.col("categories"))).alias("want"))
    offers = few.withColumn("want", F.explode(F.array_compact(F.array(F.lit("*"), F.col("category")))))
    rows = offers.join(wants, ["depth", "want"]).drop("want").withColumns({"_lo": lo, "_hi": hi})
    picks = select_top(rows, ["signature", bucket], F.col("_lo"), F.col("_hi")).drop("_lo", "_hi", "rk")
    order = F.when(F.col(bucket) == "crypto", 0).when(F.col(bucket) == "macro", 1).otherwise(2)
    return picks.withColumn("rank", F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("score"), order, "seq")))


def signature_pools(items: DataFrame, signs: DataFrame) -> DataFrame:
    """(signature, pool_before, pool_after): how many items there are, and how many of its categories."""
    total_ = F.grouping("category") == 1
    counts = items.rollup("category").agg(F.count(F.lit(1)).alias("n"), total_.alias("all"))  # a row a category, and one for all
    counts = counts.filter(F.col("all") | F.col("category").isNotNull()).select(F.when(F.col("all"), "*").otherwise(F.col("category")).alias("want"), "n")
    wants = signs.select("signature", (F.size("categories") == len(V.CATEGORIES)).alias("full"), F.explode(F.array_append("categories", "*")).alias("want"))
    sums = wants.join(counts, "want").groupBy("signature", "full").agg(F.sum(F.when(F.col("want") == "*", F.col("n"))).alias("pool_before"), F.sum(F.when(F.col("want") != "*", F.col("n"))).alias("mine"))
    return sums.select("signature", "pool_before", F.when(F.col("full"), F.col("pool_before")).otherwise(F.coalesce("mine", F.lit(0))).alias("pool_after"))
