"""Row functions against the fixtures' expected values."""

import pytest
from pyspark.sql import functions as F

from ledeforge.functions import render, scoring, text
from ledeforge.operators import dedupe, filters, prefs

CLICKBAIT = ["Top 10 Altcoins To Buy In September", "5 Reasons Bitcoin Could Explode This Quarter", "XRP Price Prediction: $10 By December?", "Best Of Crypto Twitter This Week"]
CLEAN = ["SEC approves spot Solana ETF applications from three issuers", "Curve Finance exploited for $62 million in reentrancy attack", "Fed holds rates steady, signals one cut before year end"]
TICKS = ["Ethereum breaks above $4,200", "Bitcoin currently trading at $118,400"]
NO_TICKS = ["Bitcoin slips below $63,000 as analysts warn of ETF outflows", "Ethereum breaks above $4,200 after Fusaka upgrade", "Spot ETFs pulled in $2.00 billion last week", "Bitcoin fell to 200-day moving average"]


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(col).collect()]


def titles(spark, values, f):
    return one(spark, [(v,) for v in values], "title string", f(F.col("title")))


def test_filters(spark):
    assert titles(spark, CLICKBAIT, filters.is_clickbait) == [True] * 4
    assert not any(titles(spark, CLEAN, filters.is_clickbait) + titles(spark, CLEAN, filters.is_price_tick))
    assert titles(spark, TICKS, filters.is_price_tick) == [True] * 2
    assert titles(spark, NO_TICKS, filters.is_price_tick) == [False] * 4
    assert titles(spark, ["Republican senators push back on new steel tariff plan", "World Cup ticket prices spark fan backlash"], filters.is_macro_offtopic) == [False, True]


def test_reject_reason(spark):
    rows = [("Top 10 Coins To Watch", "crypto"), ("Bitcoin breaks above $70,000", "crypto"), ("Fed cuts rates by 25bps", "macro"), ("x", "crypto"), (None, "crypto"), ("World Cup ticket prices spark fan backlash", "macro"), ("World Cup ticket prices spark fan backlash", "crypto")]
    assert one(spark, rows, "title string, bucket string", filters.reject_reason(F.col("title"), F.col("bucket"))) == ["clickbait", "price_tick", None, "no_title", "no_title", "macro_offtopic", None]


@pytest.mark.parametrize(
    ("title", "tags", "expected"),
    [
        ("Fed cuts rates", [], 1.0), ("Curve Finance exploited for $62m", [], 1.0), ("Exchange files for bankruptcy protection", [], 1.0),
        ("SEC approves spot Solana ETFs", [], 0.75), ("Treasury yields climb after auction", [], 0.5), ("Network upgrades scheduled for next month", [], 0.5),
        ("Company announces new partnership deal", [], 0.0), ("Startup secures Series B funding round", [], 0.0),
        ("Gold sold off", [], 0.25), ("A rating for the ward", [], 0.75),
    ],
)
def test_keyword(spark, title, tags, expected):
    assert one(spark, [(title, tags)], "title string, tags array<string>", scoring.keyword()[0].cast("double")) == [expected]


def test_style_and_assets(spark):
    figures = ["Hedge funds trail the S&P 500", "Inflows reached $2.1 billion", "ETF hits $2.1B, up 43%", "1,000 of 2,000 at 5%"]
    assert one(spark, [(t,) for t in figures], "title string", scoring.numeric()[0]) == [0.0, 0.35, 0.75, 1.0]
    said = [("SEC approves spot Solana ETF", ""), ("Analysts warn ETF flows may reverse", ""), ("Bitcoin surge is liquidity-driven: Bernstein", ""), ("Why it fell", "x" * 221)]
    assert one(spark, said, "title string, summary string", F.round(scoring.analysis()[0], 6)) == [0.0, 0.4, 0.4, 0.6]
    assert titles(spark, ["Fed holds rates steady", "Bitcoin, ether and solana climb"], scoring.primary_subject) == [None, "bitcoin"]
    assert one(spark, [(n,) for n in (1, 2, 3, 4, 9)], "source_count int", scoring.source_count()[0]) == [0.0, 0.2, 0.55, 0.55, 1.0]


def test_words_and_entities(spark):
    a, b = titles(spark, ["BTC surges past $70,000.00", "Bitcoin climbs past 70000 USD"], text.normal_tokens)
    assert {"bitcoin", "rally", "70000"} <= set(a) & set(b)
    whale, us = titles(spark, ["Whale moves 1,550 Bitcoin in 2026", "The New US Treasury Report On Wall Street"], text.entity_tokens)
    assert "1550" in whale and "2026" not in whale
    assert "treasury" in us and not {"wall", "street", "us"} & set(us)
    assert one(spark, [(n,) for n in (8, 41, 150)], "n int", dedupe.rarity_ceiling(F.col("n"))) == [2, 4, 4]


def test_rendering(spark):
    assert one(spark, [(s,) for s in (0.66, 0.649, 0.56, 0.38)], "s double", render.signal_band(F.col("s"))) == ["Strong", "Strong", "Notable", "Context"]
    assert one(spark, [(n,) for n in (1, 2, 4)], "n int", render.outlets_text(F.col("n"))) == ["", "+1 outlet agrees", "+3 outlets agree"]
    assert one(spark, [(h,) for h in (0.5, 5.9, 49.0)], "h double", render.age_text(F.col("h"))) == ["30m ago", "5h ago", "2d ago"]
    assert titles(spark, [None, "regulation"], render.badge) == ["📰 General", "⚖️ Regulation"]
    assert titles(spark, ["a<b> & \"c\""], text.html_escape) == ['a&lt;b&gt; &amp; "c"']
    assert titles(spark, ["https://x.org/a/?q=1", "https://x.org/a#top"], text.url_key) == ["https://x.org/a", "https://x.org/a#top"]
    assert titles(spark, ["alpha beta gamma", "short"], lambda c: render.ellipsize(c, 12)) == ["alpha beta…", "short"]


def test_split_messages_keeps_everything(spark):
    text_ = "\n\n".join(["a" * 30, "b" * 30, "c" * 250, "d" * 20])
    parts = titles(spark, [text_], lambda c: render.split_messages(c, 100))[0]
    assert all(len(p) <= 100 for p in parts)
    assert "".join(parts).replace("\n", "") == text_.replace("\n", "")
    assert titles(spark, ["short"], lambda c: render.split_messages(c, 100)) == [["short"]]


def test_preferences(spark):
    raw = spark.createDataFrame([('{"1": {"categories": [], "depth": "x"}, "2": {"categories": ["macro", "?"], "depth": "data"}}',), ("{corrupt",)], "value string")
    p = {r["chat_id"]: r for r in prefs.parse_prefs(raw).collect()}
    assert len(p["1"]["categories"]) == 5 and p["1"]["depth"] == "balanced"
    assert p["2"]["categories"] == ["macro"] and p["2"]["depth"] == "data"


def test_settings():
    from ledeforge.sources.market import Settings

    assert Settings.load({"LLM_CHAIN": "a, b"}).models == ("a", "b")
    assert Settings.load({}).threshold(0.0) == 0.72
    with pytest.raises(ValueError):
        Settings.load({"DIGEST_TIME": "25:00"})


def test_score_equals_the_sql_to_the_last_digit(spark):
    import duckdb

    from ledeforge.plans import sql

    # one step below the threshold in floats, which a divisor just under 1 would lift onto it
    raw = {"keyword": 0.0, "recency": 1.0, "source_quality": 1.0, "topicality": 0.0, "source_count": 0.0, "numeric": 0.35, "analysis": 0.55, "asset": 1.0}
    weights = scoring.weights_for("balanced")
    want = duckdb.connect().execute(f"SELECT {sql.total(weights)} FROM (SELECT {', '.join(f'{v!r}::DOUBLE AS raw_{n}' for n, v in raw.items())})").fetchone()[0]
    rows = spark.createDataFrame([tuple(raw.values())], ", ".join(f"raw_{n} double" for n in raw))
    assert rows.select(scoring.total(weights)).first()[0] == want == 0.49999999999999994
