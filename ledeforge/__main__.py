"""Command line: ``python -m ledeforge --demo`` ranks the demo set, without it the live feeds, and prints a reader's digest."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeforge.functions import render
from ledeforge.functions import vocabulary as V
from ledeforge.operators.prefs import sane_categories, sane_depth
from ledeforge.plans import ranking
from ledeforge.sources import feeds


def fetched(spark: SparkSession, now: datetime) -> DataFrame:
    """Kept items of all feeds as they are now."""
    spark.dataSource.register(feeds.FeedSource)
    bodies = spark.read.format("feeds").load().select("label", "body")
    items = feeds.parse_feeds(bodies, feeds.feeds_table(spark), F.lit(now).cast("timestamp"))
    return items.filter("reject IS NULL").drop("reject")


def lines(run: ranking.RankingRun, now, digest: DataFrame) -> list[str]:
    """What is printed: the digest, and a line for each selected item with its bar."""
    d = digest.first()
    out = [d["headline"], *(f"  - {b}" for b in d["bullets"]), ""]
    shown = run.items.select(render.fixed(F.col("score"), 3).alias("s"), render.score_bar(F.col("score")).alias("bar"), render.ellipsize(F.col("title"), 72).alias("t"), "source")
    return out + [f"{r['s']} {r['bar']:<20} {r['t']}  [{r['source']}]" for r in shown.collect()]  # 18 rows at most


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ask = argparse.ArgumentParser(prog="ledeforge", description="Ranks headlines and prints the digest of one reader.")
    ask.add_argument("--demo", action="store_true", help="rank the demo set")
    ask.add_argument("--depth", choices=list(V.DEPTH_SPLITS), default="balanced")
    ask.add_argument("--categories", default="", help="comma-separated; none means all")
    given = ask.parse_args(argv)
    spark = spark or SparkSession.builder.appName("ledeforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime(2026, 8, 21, 12, tzinfo=UTC) if given.demo else datetime.now(UTC)
    chosen = [c.strip() for c in given.categories.split(",") if c.strip()]
    reader = spark.createDataFrame([(chosen, given.depth)], "c array<string>, d string").select(sane_categories(F.col("c")).alias("c"), sane_depth(F.col("d")).alias("d")).first()
    items = feeds.demo_items(spark).filter("reject IS NULL").drop("reject") if given.demo else fetched(spark, now)
    at = F.lit(now).cast("timestamp")
    run = ranking.run(items, at, reader["c"], reader["d"])
    ranked = run.items.withColumn("rank", F.row_number().over(ranking.by_score()))
    print("\n".join(lines(run, at, ranking.digest(ranked))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
