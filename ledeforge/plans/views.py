"""Views of the driver's tables as news: headlines over events, first lines over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V

NOW = "2024-01-31 00:00:00"

#: Headlines dealt to events by id; between them they reach every rule, factor level, category and subject.
HEADLINES = [
    "Top 7 tokens our readers hold",
    "4 ways miners cut their power bill",
    "Solana price forecast for the coming winter",
    "The best of our weekend columns",
    "Ripple could hit a new record, a chart suggests",
    "Your crypto watchlist for Tuesday",
    "Celebrity chef opens a bank-themed diner",
    "8 altcoins to own before spring",
    "Here's what traders say comes next",
    "Regulator sues two lenders over unlicensed custody",
    "Lending pool drained of $14 million through a price oracle",
    "Central bank leaves its rate unchanged and hints at a cut",
    "Bitcoin rises above $91,300",
    "Ether currently trading at $3,150",
    "Bitcoin falls below $88,000 as miners sell reserves",
    "Ether jumped past 3,200 USDT following a fork",
    "Funds took in $640 million over five days",
    "Bitcoin slips to 50-day average",
    "Senators debate tariff relief for farm machinery",
    "Olympics ticket prices anger travelling fans",
    "Polls show a tight midterm race in three states",
    "Dogecoin up 6.4% intraday",
    "ok",
    "",
    "Broker halts withdrawals and files for insolvency",
    "Bond auction draws weak bids, yields rise 9%",
    "Validators schedule the next network upgrade",
    "Two studios agree on a joint label",
    "Payments startup closes a funding round",
    "Hedge funds lag the S&P 500 for a third quarter",
    "ETF inflows hit $1.7 billion, a 38% rise over 2 weeks",
    "Strategists warn that inflation may return",
    "Bitcoin, ether and XRP trade flat",
    "Issuer freezes $5 million USDT after a court order",
    "An NFT gallery hires three curators",
    "Why a staking tweak could lift Ethereum: Northbridge Research",
    "BNB validators patch a vulnerability after a $900,000 exploit",
    "Oil output rises while shipping costs fall 3.5%",
    "How memecoin traders lost 12,400 dollars in 2 hours",
    "BlackRock moves 1,250 bitcoin to a new custodian",
    "Sanctions list grows by 40 wallets, treasury says",
    "Stablecoin supply reaches $310 billion, up 4% in May",
    "Analysts expect a rate cut: Harbor Street Desk",
    "Data breach at a payments firm exposes 75,000 accounts",
    "Doge slides and shib follows, explainer inside",
    "Hacker returns stolen funds to lending protocol",
]
SOURCES = [*V.SOURCE_QUALITY, "Unknown Blog"]
TAGSETS = [["markets"], ["crypto", "Monetary_Policy"], [], ["sports"], ["unmapped", "travel"], ["regulation", "etf"], ["DeFi"]]
MACRO_SOURCES = [f[0] for f in V.FEEDS if f[2] == "macro"]


#: Items of one ranking run, as the views deal them.
BATCH_ITEMS = 250


def dealt(values: list, number: Column) -> Column:
    """The entry of a short list by number."""
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.get(F.array(*map(lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news item for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("seq"), "user_id")
    source = dealt(SOURCES, F.col("user_id"))
    back = F.pmod(F.col("seq") * 7919, F.lit(2880)).cast("int")
    return e.select(
        "seq", dealt(HEADLINES, F.col("seq")).alias("title"), source.alias("source"),
        F.when(source.isin(MACRO_SOURCES), "macro").otherwise("crypto").alias("bucket"),
        dealt(TAGSETS, F.col("seq")).alias("tags"), (now() - F.make_dt_interval(F.lit(0), F.lit(0), back)).alias("published_at"),
        F.concat(F.lit("https://example.com/s/"), F.pmod("seq", F.lit(500)).cast("string"), F.lit("/?u="), F.col("user_id").cast("string")).alias("url"),
        F.repeat(F.lit("word "), F.pmod("seq", F.lit(60)).cast("int")).alias("summary"), (F.pmod("seq", F.lit(6)) + 1).cast("int").alias("source_count"),
    )


def news_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news item for each document: its first line is the title and its whole text the summary; ids make batches of up to ``BATCH_ITEMS``, so a larger table has more of them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("seq"), "text", "lang", "source")
    back = F.pmod(F.col("seq") * 7919, F.lit(2880)).cast("int")
    return d.select(
        "seq", F.floor(F.col("seq") / BATCH_ITEMS).cast("string").alias("batch"), F.substring_index("text", "\n", 1).alias("title"), "source",
        F.when(F.pmod("seq", F.lit(3)) == 0, "macro").otherwise("crypto").alias("bucket"), F.array("lang").alias("tags"),
        (now() - F.make_dt_interval(F.lit(0), F.lit(0), back)).alias("published_at"), F.concat(F.lit("https://example.com/d/"), F.col("seq").cast("string")).alias("url"),
        F.col("text").alias("summary"), F.lit(1).alias("source_count"),
    )


def readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader (chat_id, categories, depth) for each user of ``events``: the bits of the id choose categories, and none means all."""
    from ledeforge.operators import prefs

    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("chat_id")).filter(F.col("chat_id").isNotNull()).distinct()
    bits = F.array_compact(F.array(*(F.when(F.getbit("chat_id", F.lit(k)) == 1, F.lit(c)) for k, c in enumerate(V.CATEGORIES))))
    return users.select("chat_id", prefs.sane_categories(bits).alias("categories"), prefs.sane_depth(dealt(list(V.DEPTH_SPLITS), F.col("chat_id"))).alias("depth"))


#: Entries of one poll, as the views deal documents to feeds.
POLL_DOCS = 250
TITLE_CHARS = r"[^\p{L}\p{N} ,.%$:-]"


def feed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poll, label, body): documents as entries of feeds, RSS and Atom by turns; some entries have no date or no web address, and some bodies are missing."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), "text", "lang")
    kinds = len(V.FEEDS)
    at = now() - F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.col("id") * 7919, F.lit(5000)).cast("int"))
    title = F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), TITLE_CHARS, "")
    link = F.concat(F.when(F.col("id") % 17 == 0, "ftp").otherwise("https"), F.lit("://example.com/d/"), F.col("id").cast("string"))
    dated = F.col("id") % 13 != 0
    blurb = F.concat(F.lit("&lt;p&gt;"), title, F.lit("&lt;/p&gt;  &amp; more"))
    rss = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><description>"), blurb, F.lit("</description>"),
        F.when(dated, F.concat(F.lit("<pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"))).otherwise(""),
        F.lit("<category>"), F.upper("lang"), F.lit("</category><category>Markets</category></item>"),
    )
    atom = F.concat(
        F.lit("<entry><title>"), title, F.lit('</title><link href="'), link, F.lit('"/><summary type="html">'), blurb, F.lit("</summary>"),
        F.when(dated, F.concat(F.lit("<published>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</published>"))).otherwise(""),
        F.lit('<category term="'), F.upper("lang"), F.lit('"/><category term="Markets"/></entry>'),
    )
    feed = F.pmod("id", F.lit(kinds))
    entries = d.select(F.floor(F.col("id") / POLL_DOCS).alias("poll"), feed.alias("feed"), "id", F.when(feed % 2 == 0, rss).otherwise(atom).alias("entry"))
    # a poll has POLL_DOCS entries in all
    joined = entries.groupBy("poll", "feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda e: e["entry"]), "").alias("all"))
    whole = F.when(F.col("feed") % 2 == 0, F.concat(F.lit('<rss version="2.0"><channel><title>t</title>'), F.col("all"), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), F.col("all"), F.lit("</feed>")))
    return joined.select("poll", dealt([f[0] for f in V.FEEDS], F.col("feed")).alias("label"), F.when((F.col("poll") + F.col("feed")) % 11 != 0, whole).alias("body"))


def market_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poll, tickers, mood): answers of the market services as text, one poll a customer; some are broken."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("poll"))
    n = F.col("poll")
    coin = lambda name, price, change: F.concat(F.lit(f'{{"symbol": "{name}", "lastPrice": "'), price, F.lit('", "priceChangePercent": "'), change, F.lit('"}'))
    num = lambda x: x.cast("string")
    btc = coin("BTCUSDT", F.concat(num(n * 37 % 90000), F.lit(".5")), F.concat(num(n % 200 - 100), F.lit(".26")))
    eth = coin("ETHUSDT", F.when(n % 5 == 0, "n/a").otherwise(num(n * 11 % 5000)), F.concat(num(n % 30), F.lit(".31")))
    tickers = F.when(n % 7 == 0, "broken").otherwise(F.concat(F.lit("["), eth, F.lit(", "), coin("PEPEUSDT", F.lit("1"), F.lit("0")), F.lit(", "), btc, F.lit("]")))
    mood = F.when(n % 3 == 0, "{}").otherwise(F.concat(F.lit('{"data": [{"value": "'), num(n % 101), F.lit('", "value_classification": "Greed & "}]}')))
    return c.select("poll", tickers.alias("tickers"), mood.alias("mood"))


def stored_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat, value): a preference file for each user of ``events``; some have unknown names or don't parse."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("chat")).filter(F.col("chat").isNotNull()).distinct()
    bits = F.array_compact(F.array(F.lit("nonsense"), *(F.when(F.getbit("chat", F.lit(k)) == 1, F.lit(c)) for k, c in enumerate(V.CATEGORIES))))
    depth = dealt([*V.DEPTH_SPLITS, "loud"], F.col("chat"))
    body = F.to_json(F.create_map(F.col("chat").cast("string"), F.struct(bits.alias("categories"), depth.alias("depth"))))
    return users.select("chat", F.when(F.col("chat") % 9 == 0, "{broken").otherwise(body).alias("value"))
