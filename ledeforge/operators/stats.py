"""Counts that a run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reject_counts(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, reason, n) of rejected items."""
    return items.filter(F.col("reject").isNotNull()).groupBy(*(by or []), F.col("reject").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kept_per_source(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """(source, kept) with zeros for silent feeds."""
    kept = items.filter(F.col("reject").isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    return feeds.select(F.col("label").alias("source")).join(kept, "source", "left").select("source", F.coalesce("kept", F.lit(0)).alias("kept"))


def feed_stats(bodies: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feeds_total, feeds_ok, feeds_failed, items_kept) of each run: a failed feed has a null body, and one whose body holds no item has merely none. Runs have a dozen feeds."""
    failed = F.sort_array(F.collect_set(F.when(F.col("body").isNull(), F.col("label"))))
    feeds = bodies.groupBy(*keys).agg(F.count_distinct("label").alias("feeds_total"), failed.alias("feeds_failed"))
    kept = items.filter(F.col("reject").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("items_kept"))
    health = feeds.withColumn("feeds_ok", F.col("feeds_total") - F.size("feeds_failed"))
    return health.join(kept, keys, "left").select(*keys, "feeds_total", "feeds_ok", "feeds_failed", F.coalesce("items_kept", F.lit(0)).alias("items_kept"))


def bucket_rollup(fetched: DataFrame, merged: DataFrame, selected: DataFrame) -> DataFrame:
    """(bucket, fetched, after_dedupe, selected) with a null bucket for the totals."""
    tagged = [d.select("bucket", *(F.lit(int(k == i)).alias(n) for k, n in enumerate(("fetched", "after_dedupe", "selected")))) for i, d in enumerate((fetched, merged, selected))]
    union = tagged[0].union(tagged[1]).union(tagged[2])
    return union.rollup("bucket").agg(*(F.sum(n).alias(n) for n in ("fetched", "after_dedupe", "selected")))


def pool_stats(items: DataFrame, enabled: set[str] | None) -> DataFrame:
    """(pool_before, pool_after, filtered_by_category)."""
    inside = F.col("category").isin(sorted(enabled)) if enabled else F.lit(True)
    return items.agg(F.count(F.lit(1)).alias("pool_before"), F.count_if(inside).alias("pool_after")).withColumn("filtered_by_category", F.lit(bool(enabled)))


def spread(items: DataFrame, col: str) -> DataFrame:
    """(mean, stddev, levels) of a factor."""
    return items.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("stddev"), F.count_distinct(col).alias("levels"))
