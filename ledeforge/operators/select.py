"""Ranking and adaptive selection, declared with window functions over bounded prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V


def rank_items(scored: DataFrame, partition: list[str], order: list[Column] | None = None) -> DataFrame:
    """Adds ``rk`` by score, ties by ``seq``."""
    return scored.withColumn("rk", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("score"), *(order or [F.col("seq")]))))


#: Largest ``max_n`` and ``min_n`` that callers give as columns.
MOST = max(n for pair in V.LIMITS.values() for n in pair)


def best_of(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each key by score and ``seq``, numbered as ``name``; each task sends on no more than these."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "seq"))
    return rows.withColumn(name, place).filter(F.col(name) <= n)


def select_top(scored: DataFrame, partition: list[str] | None = None, min_n: Column | int = 6, max_n: Column | int = 12, threshold: float = V.SCORE_THRESHOLD, max_per_subject: int = V.MAX_PER_SUBJECT, most: int = MOST) -> DataFrame:
    """An adaptive top of each partition of (score, subject, seq).

    Items at or above ``threshold`` make the pool; if they are fewer than
    ``min_n``, the first ``min_n`` by rank do. Along the pool a subject may take
    ``max_per_subject`` places, up to ``max_n`` in all; held items fill up to
    ``min_n``. Ranked by score, at equal scores picked before filled; adds
    ``pick`` (place from 1) and ``backfill``.

    ``most`` is no less than any ``min_n`` or ``max_n`` given as a column. Of a
    subject, the first ``max_per_subject`` can be picked and the next ``min_n``
    held; of those that may be picked, and of those that may be held, no more than
    ``most`` matter to any later step, the gate included. So each partition is cut
    to 2 * ``most`` rows before any window runs over it as a whole.
    """
    part = partition or ["bucket"]
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (min_n, max_n))
    most = max([most, *(x for x in (min_n, max_n) if isinstance(x, int))])
    named = best_of(scored, [*part, "subject"], max_per_subject + most, "_srk")
    walk = named.withColumn("_ok", F.col("subject").isNull() | (F.col("_srk") <= max_per_subject))
    walk = best_of(walk, [*part, "_ok"], most, "_krk").drop("_srk", "_krk")
    whole = Window.partitionBy(*part)
    ranked = rank_items(walk, part).withColumn("_g", F.count_if(F.col("score") >= threshold).over(whole))
    pool = ranked.filter(F.col("rk") <= F.when(F.col("_g") < lo, lo).otherwise(F.col("_g")))
    running = Window.partitionBy(*part).orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    walk = pool.withColumn("_pos", F.count_if("_ok").over(running))
    walk = walk.withColumn("_np", F.least(F.count_if("_ok").over(whole), hi))
    walk = walk.withColumn("_held", ~F.col("_ok") & (F.col("_pos") < hi))
    walk = walk.withColumn("_hrk", F.count_if("_held").over(running))
    walk = walk.withColumn("backfill", F.col("_held") & (F.col("_hrk") <= lo - F.col("_np")))
    chosen = walk.filter((F.col("_ok") & (F.col("_pos") <= hi)) | F.col("backfill"))
    pick = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("score"), "backfill", "rk"))
    return chosen.withColumn("pick", pick).filter(F.col("pick") <= hi).drop("_g", "_ok", "_pos", "_np", "_held", "_hrk")


def final_merge(selected: DataFrame) -> DataFrame:
    """All buckets in one order: score, then crypto before macro, then feed order."""
    bucket_ord = F.when(F.col("bucket") == "crypto", 0).when(F.col("bucket") == "macro", 1).otherwise(2)
    return selected.withColumn("bucket_ord", bucket_ord).orderBy(F.desc("score"), "bucket_ord", "seq")


def top_n(scored: DataFrame, n: int = 5) -> DataFrame:
    """The best ``n`` items, between 1 and 10."""
    return scored.orderBy(F.desc("score"), "seq").limit(max(1, min(10, n)))


def nth(scored: DataFrame, n: int) -> DataFrame:
    """The ``n``-th best item, counted from 1; none where out of range."""
    return scored.orderBy(F.desc("score"), "seq").offset(max(0, n - 1)).limit(1 if n >= 1 else 0)
