"""Batches: scores, dedupe, selection, runs and alerts."""

import random

import pytest
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import score_items, weights_for
from ledeforge.operators import dedupe
from ledeforge.operators.graph import connected_components
from ledeforge.operators.select import select_top
from ledeforge.plans import ranking
from ledeforge.sources.feeds import demo_items

NOW = "2026-08-22 12:00:00"
SCHEMA = "seq long, title string, source string, age double, tags array<string>"


def items(spark, rows, batch="b"):
    src = spark.createDataFrame([(k, t, s, float(a), list(tags)) for k, (t, s, a, tags) in enumerate(rows)], SCHEMA)
    return src.withColumns({"batch": F.lit(batch), "url": F.concat(F.lit("https://example.com/"), "seq"), "bucket": F.lit("crypto"), "summary": F.lit(""), "source_count": F.lit(1), "published_at": F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("age") * 60).cast("int"))})


@pytest.mark.parametrize(("depth", "expected"), [("balanced", 0.7342), ("data", 0.7587), ("analysis", 0.7097)])
def test_worked_example(spark, depth, expected):
    one = items(spark, [("Curve Finance exploited for $62 million in reentrancy attack", "DL News", 1.5, ["defi"])]).withColumn("source_count", F.lit(2))
    row = score_items(one, F.lit(NOW).cast("timestamp"), weights_for(depth)).first()
    assert row["score"] == pytest.approx(expected, abs=1e-4)
    assert sum(f["contribution"] for f in row["breakdown"]) == pytest.approx(row["score"], abs=1e-9)


def test_unknown_factor(spark):
    with pytest.raises(KeyError):
        score_items(items(spark, [("a title here", "CNBC", 1, [])]), F.lit(NOW).cast("timestamp"), {"nonsense": 1.0})


@pytest.mark.parametrize(
    ("titles", "expected"),
    [
        ([("SEC approves spot Solana ETF applications from three issuers", "The Block"), ("SEC clears spot Solana ETFs in reversal of earlier guidance", "CoinDesk"), ("Solana spot ETFs approved by the SEC, trading opens Monday", "Unchained")], 1),
        ([("Apollo Global reveals data breach after hackers target financial firms", "A"), ("Apollo says hackers accessed personal data in latest Wall Street breach", "B")], 1),
        ([("Tether mints $2 billion USDT on Ethereum", "A"), ("Fed holds rates steady, signals one cut before year end", "B"), ("Curve Finance exploited for $62 million", "C")], 3),
    ],
)
def test_dedupe_fixtures(spark, titles, expected):
    merged = dedupe.dedupe(items(spark, [(t, s, 1, []) for t, s in titles])).collect()
    assert len(merged) == expected
    if expected == 1:
        assert merged[0]["source_count"] == len(titles)
        assert merged[0]["merged_sources"] == sorted(s for _, s in titles)
        assert merged[0]["seq"] == 0


def test_closure_and_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: root(n) for n in parent if root(n) != n}
    assert {n: c for n, c in got.items() if n != c} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_select(rows, lo, hi, cap=3, threshold=0.3):
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    pool = [r for r in ranked if r[1] >= threshold]
    if len(pool) < lo:
        pool = ranked[:lo]
    out, held, seen = [], [], {}
    for r in pool:
        if len(out) >= hi:
            break
        if r[2] is not None and seen.get(r[2], 0) >= cap:
            held.append(r)
            continue
        seen[r[2]] = seen.get(r[2], 0) + 1
        out.append(r)
    out += held[: max(0, lo - len(out))]
    return [r[0] for r in sorted(out, key=lambda r: -r[1])[:hi]]


def test_selection_against_a_loop(spark):
    rng, rows, want = random.Random(11), [], {}
    for case in range(300):
        lo, hi = rng.randrange(0, 8), rng.randrange(0, 10)
        part = [(k, rng.choice([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), rng.choice([None, "bitcoin", "xrp"])) for k in range(rng.randrange(0, 14))]
        want[case] = naive_select(part, lo, hi, cap=2)
        rows += [(case, *r, lo, hi) for r in part]
    df = spark.createDataFrame(rows, "bucket int, seq long, score double, subject string, lo int, hi int")
    got = {}
    for r in select_top(df, ["bucket"], F.col("lo"), F.col("hi"), max_per_subject=2).orderBy("bucket", "pick").collect():
        got.setdefault(r["bucket"], []).append(r["seq"])
    assert got == {k: v for k, v in want.items() if v}


def test_demo_ranking(spark):
    demo = demo_items(spark)
    assert dict(demo.filter(F.col("reject").isNotNull()).groupBy("reject").count().collect()) == {"clickbait": 2, "price_tick": 1, "macro_offtopic": 1}
    r = ranking.run(demo.filter(F.col("reject").isNull()).drop("reject"), F.lit("2026-08-21 12:00:00").cast("timestamp"))
    got = [(round(x["score"], 4), x["title"][:12]) for x in r.items.collect()]
    assert got == [
        (0.7269, "Fed holds ra"), (0.7192, "Curve Financ"), (0.6610, "SEC clears s"), (0.6552, "Bitcoin slip"), (0.6171, "BlackRock fi"),
        (0.6017, "Treasury yie"), (0.5935, "Tether mints"), (0.5188, "ECB signals "), (0.3085, "Small NFT ma"),
    ]
    counts = {x["bucket"]: (x["fetched"], x["after_dedupe"], x["selected"]) for x in r.counts.collect()}
    assert counts == {"crypto": (8, 6, 6), "macro": (3, 3, 3), None: (11, 9, 9)}


def test_alert_marks_expire_at_marking_only(spark):
    from ledeforge.streaming import alerts

    at = lambda s: F.lit(s).cast("timestamp")
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    none = spark.createDataFrame([], "key string, marked_at timestamp")
    m = alerts.mark(none, key("a"), at("2026-01-01 00:00:00"))
    ranked = spark.createDataFrame([(1, "a", 0.9), (2, "b?x=1", 0.8), (3, "c", 0.5)], "seq long, url string, score double")
    assert [r["url"] for r in alerts.due_alerts(ranked, m, 0.0).collect()] == ["b?x=1"]
    m = alerts.mark(m, key("b"), at("2026-01-03 00:00:00"))
    assert [r["key"] for r in m.collect()] == ["b"]
    assert V.ALERT_TTL_HOURS == 48


def test_alert_stream(spark, tmp_path):
    from ledeforge.streaming import alerts

    rows = [("a", "alert", 0.9, "2026-01-01 00:00:00"), ("a", "alert", 0.9, "2026-01-02 00:00:00"), ("a", "alert", 0.9, "2026-01-03 00:00:00"), ("b", "digest", 0.1, "2026-01-01 00:00:00"), ("b", "alert", 0.9, "2026-01-01 05:00:00"), ("c", "alert", 0.5, "2026-01-01 05:00:00")]
    src = spark.createDataFrame(rows, "key string, kind string, score double, t string").select("key", "kind", "score", F.col("t").cast("timestamp").alias("ts"))
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    seen = []
    alerts.rocksdb_state(spark)
    q = alerts.poll(alerts.alert_stream(stream), lambda df, k: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted((r["key"], r["ts"].day) for r in seen) == [("a", 1), ("a", 3)]


def test_alert_stream_forgets(spark, tmp_path):
    from ledeforge.streaming import alerts

    days = [("a", "2026-01-01"), ("z", "2026-01-10"), ("z", "2026-01-13"), ("a", "2026-01-02"), ("a", "2026-01-14")]
    for k, day in days:  # one file and one batch each
        src = spark.createDataFrame([(k, "alert", 0.9, day)], "key string, kind string, score double, t string").select("key", "kind", "score", F.col("t").cast("timestamp").alias("ts"))
        src.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    alerts.rocksdb_state(spark)
    q = alerts.poll(alerts.alert_stream(stream), lambda df, k: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(180)
    assert sorted((r["key"], r["ts"].day) for r in seen) == [("a", 1), ("a", 14), ("z", 10), ("z", 13)]  # the second of January came too late
    kept = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsRemoved"] for s in kept) >= 1
    assert max(s["numRowsTotal"] for s in kept) <= 2 * 4  # a mark and its timers, for two keys


def test_digest_falls_back(spark):
    rows = spark.createDataFrame([(1, "First", "A", "crypto", 1, "", 0.5), (2, "Second", "B", "crypto", 2, "s", 0.4)], "rank int, title string, source string, bucket string, source_count int, summary string, score double")
    d = ranking.digest(rows).first()
    assert (d["headline"], d["bullets"], d["llm_ok"]) == ("First", ["First (A)", "Second (B)"], False)
    assert ranking.digest(rows, [("m", lambda p: '{"headline": " H ", "bullets": ["x", " "]}')]).first()["bullets"] == ["x"]
    assert ranking.digest(rows, [("m", lambda p: 1 / 0)]).first()["llm_ok"] is False
    assert ranking.digest(rows.limit(0)).first()["llm_ok"] is True


def test_feed_source(spark, tmp_path):
    from ledeforge.sources.feeds import FeedSource

    good = tmp_path / "feed.xml"
    good.write_text("<rss/>")
    spark.dataSource.register(FeedSource)
    got = spark.read.format("feeds").option("urls", f"file://{good}\nfile://{tmp_path}/missing").option("timeout", "1").load().orderBy("feed_idx").collect()
    assert [r["body"] for r in got] == ["<rss/>", None]
