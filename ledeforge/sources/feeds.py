"""Feeds: fetching, parsing and the demo set."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledeforge.functions import vocabulary as V
from ledeforge.functions.text import strip_html
from ledeforge.operators.filters import cap_per_source, reject_reason, well_formed, within_window

# ---- fixed values: how feeds are asked ----
USER_AGENTS = ("Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)")
ATTEMPTS, BACKOFF, FEED_TIMEOUT = 3, (1, 6), 12

RSS = "struct<channel: struct<item: array<struct<title: string, link: string, description: string, pubDate: string, updated: string, category: array<string>>>>>"
ATOM = "struct<entry: array<struct<title: string, link: array<struct<_href: string>>, summary: string, content: string, published: string, updated: string, category: array<struct<_term: string>>>>>"


class _Feed(InputPartition):
    def __init__(self, index: int, label: str, url: str, poll: int):
        self.index, self.label, self.url, self.poll = index, label, url, poll


def _feeds(options: dict, poll: int) -> list[InputPartition]:
    """One partition a feed, so feeds are asked side by side and fail alone."""
    override = options.get("urls")
    urls = override.split("\n") if override else [f[1] for f in V.FEEDS]
    return [_Feed(k, V.FEEDS[k][0] if k < len(V.FEEDS) else f"feed {k}", u, poll) for k, u in enumerate(urls)]


def _asked(options: dict, feed: _Feed) -> Iterator[tuple]:
    body = fetch(feed.url, float(options.get("timeout", FEED_TIMEOUT)))
    yield feed.index, feed.label, body, feed.poll, datetime.now(UTC)


def _poll(options: dict) -> int:
    """The number of the present poll: whole intervals since the epoch."""
    return int(time.time() // float(options.get("seconds", 60 * V.ALERT_POLL_MINUTES)))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _feeds(self.options, _poll(self.options))

    def read(self, partition: _Feed) -> Iterator[tuple]:
        return _asked(self.options, partition)


class FeedStreamReader(DataSourceStreamReader):
    """Polls: the offset is the number of the last one. A query that was down asks once, for feeds show only what they have now."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"poll": int(self.options.get("after", _poll(self.options) - 1))}

    def latestOffset(self) -> dict:
        return {"poll": _poll(self.options)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _feeds(self.options, end["poll"]) if end["poll"] > start["poll"] else []

    def read(self, partition: _Feed) -> Iterator[tuple]:
        return _asked(self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a poll that is done."""


class FeedSource(DataSource):
    """``spark.read.format("feeds")`` and ``spark.readStream.format("feeds")``: the body of a feed that fails is null."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "feed_idx int, label string, body string, poll long, seen_at timestamp"

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))


def fetch(url: str, timeout: float, attempts: int = ATTEMPTS) -> str | None:
    """The body behind ``url`` after up to ``attempts`` tries with growing waits, else null."""
    for k in range(attempts):
        try:
            ask = urllib.request.Request(url, headers={"User-Agent": random.choice(USER_AGENTS)})
            with urllib.request.urlopen(ask, timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")
        except (OSError, ValueError, urllib.error.URLError):
            if k + 1 < attempts:
                time.sleep(min(BACKOFF[1], BACKOFF[0] * 2**k))
    return None


def feeds_table(spark: SparkSession) -> DataFrame:
    """(feed_idx, label, url, bucket, window_h)."""
    rows = [(k, *f[:3], f[3] or V.WINDOW_HOURS) for k, f in enumerate(V.FEEDS)]
    return spark.createDataFrame(rows, "feed_idx int, label string, url string, bucket string, window_h int")


def read_feed_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(label, body) from a file for each feed; offline counterpart of the live source."""
    out = None
    for label, path in paths.items():
        one = spark.read.text(path, wholetext=True).select(F.lit(label).alias("label"), F.col("value").alias("body"))
        out = one if out is None else out.unionByName(one)
    return out


def parse_time(published: Column, updated: Column, now: Column) -> Column:
    """RFC 822 or ISO 8601, published before updated; now where neither can be read."""

    def one(c: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]+,\s*", ""), r"\b(GMT|UTC|UT)$", "+0000")
        return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(c)))

    return F.coalesce(one(published), one(updated), now)


def _entries(bodies: DataFrame) -> DataFrame:
    """Entries by the root element: ``rss`` or ``feed``; a body of another kind has none."""
    root = F.regexp_extract("body", r"<(rss|feed)\b", 1)
    atom = F.transform(
        F.from_xml("body", ATOM)["entry"],
        lambda e: F.struct(
            e["title"].alias("title"), F.get(e["link"], F.lit(0))["_href"].alias("link"), F.coalesce(e["summary"], e["content"]).alias("description"),
            e["published"].alias("pubDate"), e["updated"].alias("updated"), F.transform(e["category"], lambda c: c["_term"]).alias("category"),
        ),
    )
    items = F.when(root == "rss", F.from_xml("body", RSS)["channel"]["item"]).when(root == "feed", atom)
    return bodies.select(*(c for c in bodies.columns if c != "body"), F.posexplode(items).alias("entry_idx", "e"))


def parse_feeds(bodies: DataFrame, feeds: DataFrame, now: Column, cap: int = V.MAX_PER_SOURCE) -> DataFrame:
    """Items with their ``reject`` reason from (label, body, ...), in feed order; further columns, such as the poll, stay and part the runs.

    Entries without a title or an http address and those older than the feed's
    window vanish uncounted; a source is read up to its ``cap``-th kept item of
    a run. A null or unreadable body has no items.
    """
    keys = [c for c in bodies.columns if c not in ("label", "body", "feed_idx")]
    e = _entries(bodies.select(*keys, "label", "body")).join(feeds, "label")
    title = F.regexp_replace(F.coalesce("e.title", F.lit("")), r"(?U)^\s+|\s+$", "")
    tags = F.filter(F.transform(F.coalesce("e.category", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    items = e.select(
        *keys, (F.col("feed_idx").cast("long") * 1_000_000 + F.col("entry_idx")).alias("seq"), title.alias("title"), F.trim(F.coalesce("e.link", F.lit(""))).alias("url"),
        F.col("label").alias("source"), parse_time(F.col("e.pubDate"), F.col("e.updated"), now).alias("published_at"), "bucket", "window_h",
        tags.alias("tags"), strip_html(F.col("e.description"), V.SUMMARY_CHARS).alias("summary"), F.lit(1).alias("source_count"),
    )
    fresh = within_window(well_formed(items), now, F.col("window_h")).drop("window_h")
    return cap_per_source(fresh.withColumn("reject", reject_reason(F.col("title"), F.col("bucket"))), cap, [*keys, "source"])


# ---- fixed values: the demo set, (title, source, hours ago, tag, bucket) ----
DEMO = [
    ("SEC approves spot Solana ETF applications from three issuers", "The Block", 2.0, "regulation", "crypto"),
    ("Curve Finance exploited for $62 million in reentrancy attack", "DL News", 1.5, "defi", "crypto"),
    ("SEC clears spot Solana ETFs in reversal of earlier guidance", "CoinDesk", 2.5, "regulation", "crypto"),
    ("Solana spot ETFs approved by the SEC, trading opens Monday", "Unchained", 3.0, "regulation", "crypto"),
    ("Tether mints $2 billion USDT on Ethereum", "The Defiant", 6.0, "stablecoin", "crypto"),
    ("Bitcoin slips below $63,000 as spot ETF outflows accelerate", "CoinDesk", 4.0, "markets", "crypto"),
    ("BlackRock files for staking feature on its spot Ethereum ETF", "The Block", 8.0, "etf", "crypto"),
    ("Small NFT marketplace announces team expansion", "Decrypt", 19.0, "nft", "crypto"),
    ("Top 10 Altcoins To Buy Before September", "Decrypt", 1.0, "markets", "crypto"),
    ("XRP Price Prediction: Can It Reach $10 This Year?", "Decrypt", 2.0, "markets", "crypto"),
    ("Ethereum breaks above $4,200", "CoinDesk", 1.0, "markets", "crypto"),
    ("Fed holds rates steady, signals one cut before year end", "FT Markets", 3.0, "economy", "macro"),
    ("Treasury yields climb as inflation data surprises to the upside", "CNBC", 5.0, "markets", "macro"),
    ("ECB signals patience on further easing as core inflation cools", "ECB Press", 30.0, "monetary-policy", "macro"),
    ("World Cup ticket prices spark fan backlash across Europe", "CNBC", 2.0, "sports", "macro"),
]


def demo_items(spark: SparkSession, now: str = "2026-08-21 12:00:00") -> DataFrame:
    """The demo set in source order, with reject reasons."""
    rows = [(k, *r) for k, r in enumerate(sorted(DEMO, key=lambda r: r[1]))]
    src = spark.createDataFrame(rows, "seq long, title string, source string, hours double, tag string, bucket string")
    items = src.select("seq", "title", F.concat(F.lit("https://example.com/story-"), F.col("seq")).alias("url"), "source", (F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("hours") * 60).cast("int"))).alias("published_at"), "bucket", F.array("tag").alias("tags"), F.lit("").alias("summary"), F.lit(1).alias("source_count"))
    return items.withColumn("reject", reject_reason(F.col("title"), F.col("bucket")))
