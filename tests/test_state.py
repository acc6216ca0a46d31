"""What is kept between runs: the keyed log, rankings, preferences, alert marks, polls and the ledger of sent batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.sources.keyed_log import KeyedLog
from ledeforge.sources.ranking_cache import RankingCache, served
from ledeforge.streaming import alerts


def at(s):
    return F.lit(s).cast("timestamp")


def test_keyed_log(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/log", "k string, v int", ["k"])
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    assert log.latest().count() == 0
    log.put(rows(("a", 1), ("b", 1)), at("2026-01-01"))
    log.put(rows(("a", 2)), at("2026-01-02"))
    log.put(rows(("b", 0)), at("2025-01-01"))  # an old row that comes late
    log.remove(rows(("c", 0)), at("2026-01-02"))
    log.put(rows(("c", 5)), at("2026-01-02"))  # as old as the removal, which wins
    want = {"a": 2, "b": 1}
    assert {r["k"]: r["v"] for r in log.latest().collect()} == want
    (tmp_path / "log" / "unfinished").mkdir()
    log.compact()
    assert {r["k"]: r["v"] for r in log.latest().collect()} == want and len(log._writes()) == 1
    log.put(rows(("c", 6)), at("2026-01-03"))
    assert {r["k"]: r["v"] for r in log.latest().collect()} == want | {"c": 6}


def test_ranking_cache(spark, tmp_path):
    cache = RankingCache(spark, f"{tmp_path}/cache")
    ask = lambda *r: spark.createDataFrame(r, "chat_id string, signature string")
    ranked = spark.createDataFrame([("m|data", 1, "A"), ("m|data", 2, "B"), ("f|data", 1, "C")], "signature string, rank int, title string")
    hits = lambda who, now: {r["chat_id"] for r in cache.lookup(who, at(now)).collect() if r["version"]}
    both = ask(("1", "m|data"), ("2", "f|data"))
    assert hits(both, "2026-01-01 00:00:00") == set()
    cache.remember(both, ranked, at("2026-01-01 00:00:00"))
    assert hits(both, "2026-01-01 00:19:59.999999") == {"1", "2"}
    assert hits(both, "2026-01-01 00:20:00") == set()
    assert hits(ask(("1", "f|data"), ("3", "m|data")), "2026-01-01 00:01:00") == set()  # another signature, another chat
    got = cache.items(cache.lookup(both, at("2026-01-01 00:01:00"))).collect()
    assert sorted((r["chat_id"], r["rank"], r["title"]) for r in got) == [("1", 1, "A"), ("1", 2, "B"), ("2", 1, "C")]
    cache.invalidate(ask(("1", "")), at("2026-01-01 00:02:00"))
    assert hits(both, "2026-01-01 00:03:00") == {"2"}
    cache.remember(ask(("1", "m|data")), ranked.filter("rank = 1"), at("2026-01-01 00:30:00"))
    assert cache.expire(at("2026-01-01 00:31:00")) == 1  # the first run serves nobody now
    assert hits(both, "2026-01-01 00:31:00") == {"1"}
    with pytest.raises(LookupError):
        cache.items(cache.lookup(both, at("2027-01-01")))


def test_served_against_a_loop(spark):
    rng, asked, changes, want = random.Random(4), [], [], {}
    for chat in range(6):
        kept = None
        for k, minute in enumerate(sorted(rng.randrange(300) for _ in range(80))):
            seq, ts = chat * 1000 + k, f"2026-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
            if rng.random() < 0.1:
                changes.append((chat, ts, seq))
                kept = None
                continue
            sign = rng.choice("aab")
            want[seq] = kept is not None and kept[0] == sign and minute - kept[1] < V.CACHE_TTL_MINUTES
            kept = kept if want[seq] else (sign, minute)
            asked.append((chat, sign, ts, seq))
    a = spark.createDataFrame(asked, "chat_id long, signature string, t string, seq long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    c = spark.createDataFrame(changes, "chat_id long, t string, seq long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    assert {r["seq"]: r["hit"] for r in served(a, c).collect()} == want


def test_fires_against_a_loop():
    rng = np.random.default_rng(1)
    for case in range(200):
        n, ttl = int(rng.integers(0, 60)), int(rng.integers(1, 12))
        key = np.sort(rng.integers(0, 6, n))
        t = np.concatenate([np.sort(rng.integers(0, 50, int((key == k).sum()))) for k in range(6)] or [[]]).astype(np.int64)
        first = None if case % 2 else int(rng.integers(-12, 12))
        want, last, now = [], first, key[0] if n else None
        for k, x in zip(key.tolist(), t.tolist(), strict=True):
            if k != now:
                now, last = k, None
            want.append(last is None or x - last >= ttl)
            last = x if want[-1] else last
        assert alerts.fires(key, t, ttl, first).tolist() == want


def test_fire_once_across_batches(spark):
    rows = [(k % 3, k, f"2026-01-{1 + k // 3:02d}") for k in range(60)]
    df = spark.createDataFrame(rows, "key long, seq long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = sorted(r["seq"] for r in alerts.fire_once(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [k for k in range(60) if k // 3 % 2 == 0]  # every second day


def test_two_writers_keep_their_readers(spark, tmp_path):
    from ledeforge.sources.market import PrefsStore

    row = lambda *r: spark.createDataFrame(r, "chat_id string, categories array<string>, depth string")
    one, two = PrefsStore(spark, f"{tmp_path}/prefs"), PrefsStore(spark, f"{tmp_path}/prefs")
    one.update(row(('a"b', ["macro", "?"], "data")), at("2026-01-01"))
    two.update(row(("2", ["flows", "security"], "analysis")), at("2026-01-01"))
    one.update(row(('a"b', [], "loud")), at("2026-01-02"))
    assert {r["chat_id"]: (r["categories"], r["depth"]) for r in two.load().collect()} == {'a"b': (sorted(V.CATEGORIES), "balanced"), "2": (["flows", "security"], "analysis")}
    got = two.get(spark.createDataFrame([("2",), ("9",)], "chat_id string")).collect()
    assert {r["chat_id"]: r["depth"] for r in got} == {"2": "analysis", "9": "balanced"}


def _stream(spark, path, rows, per_trigger=None):
    for r in rows:  # one file and one batch each
        one = spark.createDataFrame([r], "key string, kind string, score double, t string").select("key", "kind", "score", F.col("t").cast("timestamp").alias("ts"))
        one.coalesce(1).write.mode("append").parquet(path)
    reader = spark.readStream.schema("key string, kind string, score double, ts timestamp")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def test_alert_stream_begins_with_the_batch_marks(spark, tmp_path):
    alerts.rocksdb_state(spark)
    rows = [("a", "alert", 0.9, "2026-01-02"), ("b", "alert", 0.9, "2026-01-02"), ("a", "alert", 0.9, "2026-01-04"), ("c", "alert", 0.9, "2026-01-04"), ("d", "alert", 0.1, "2026-01-04")]
    marked = spark.createDataFrame([("a", "2026-01-01 12:00:00"), ("c", "2025-12-01 00:00:00")], "key string, t string").select("key", F.col("t").cast("timestamp").alias("marked_at"))
    seen = []
    q = alerts.poll(alerts.alert_stream(_stream(spark, f"{tmp_path}/in", rows, 1), marked=marked), lambda df, k: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(180)
    assert sorted((r["key"], r["ts"].day) for r in seen) == [("a", 4), ("b", 2), ("c", 4)]


def test_a_replayed_batch_sends_nothing_twice(spark, tmp_path):
    sent, fail = [], [True]

    def handle(rows, batch):
        got = [r["id"] for r in rows.orderBy("id").collect()]
        if fail[0]:
            raise OSError("down before anything went")
        sent.append((batch, got))

    send = alerts.once(handle, f"file://{tmp_path}/ledger")
    with pytest.raises(OSError):
        send(spark.range(3), 0)
    fail[0] = False
    send(spark.range(5), 0)  # a retry gets the rows of the first try
    send(spark.range(5), 0)
    send(spark.range(2), 1)
    assert sent == [(0, [0, 1, 2]), (1, [0, 1])]


def test_windows_of_feeds_in_a_stream(spark, tmp_path):
    from ledeforge.sources.feeds import feeds_table

    now = "2026-01-10 00:00:00"
    rows = [("CNBC", "2026-01-09 00:00:00"), ("CNBC", "2026-01-08 23:59:59"), ("ECB Press", "2026-01-07 00:00:00"), ("ECB Press", "2026-01-06 23:59:59"), ("Nobody", now)]
    src = spark.createDataFrame(rows, "source string, t string").select("source", F.col("t").cast("timestamp").alias("published_at"), at(now).alias("seen_at"))
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    seen = []
    q = alerts.poll(alerts.fresh_rows(stream, feeds_table(spark)), lambda df, k: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted((r["source"], r["published_at"].day) for r in seen) == [("CNBC", 9), ("ECB Press", 7)]


RSS = """<rss version="2.0"><channel><title>t</title>
<item><title>Fed holds rates &amp; signals a cut</title><link>https://example.com/1?x=1</link><description>&lt;p&gt;Long   read&lt;/p&gt;</description><pubDate>Tue, 30 Jan 2024 23:00:00 GMT</pubDate><category>Economy</category></item>
<item><title>No date in this tariff story</title><link>https://example.com/5</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
<entry><title type="html">ECB keeps its key rates</title><link rel="alternate" href="https://example.org/e"/><content>Body text</content><updated>2024-01-30T20:00:00Z</updated><category term="Policy"/></entry></feed>"""


def test_feeds_by_root_element(spark):
    from ledeforge.sources.feeds import feeds_table, parse_feeds

    bodies = spark.createDataFrame([(0, "CNBC", RSS), (0, "ECB Press", ATOM), (0, "Decrypt", None), (0, "Unchained", "not xml"), (1, "CNBC", ATOM)], "poll int, label string, body string")
    got = parse_feeds(bodies, feeds_table(spark), at("2024-01-31")).orderBy("poll", "seq").collect()
    assert [(r["poll"], r["source"], r["title"], list(r["tags"]), r["summary"]) for r in got] == [
        (0, "CNBC", "Fed holds rates & signals a cut", ["economy"], "Long read"), (0, "CNBC", "No date in this tariff story", [], ""),
        (0, "ECB Press", "ECB keeps its key rates", ["policy"], "Body text"), (1, "CNBC", "ECB keeps its key rates", ["policy"], "Body text"),
    ]
    assert got[2]["published_at"].hour == 20 and got[2]["url"] == "https://example.org/e"


def test_feeds_as_a_stream_of_polls(spark, tmp_path):
    from ledeforge.sources.feeds import FeedSource

    (tmp_path / "feed.xml").write_text(RSS)
    spark.dataSource.register(FeedSource)
    stream = spark.readStream.format("feeds").option("urls", f"file://{tmp_path}/feed.xml\nfile://{tmp_path}/missing").option("timeout", "1").option("after", "0").load()
    seen = []
    q = alerts.poll(stream, lambda df, k: seen.append(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert [sorted((r["label"], r["body"] is not None) for r in rows) for rows in seen if rows] == [[("CoinDesk", True), ("The Block", False)]]
    q = alerts.poll(stream, lambda df, k: seen.append(df.collect()), f"{tmp_path}/cp")  # within the same poll nothing is asked again
    q.awaitTermination(120)
    assert sum(1 for rows in seen if rows) == 1


def test_digests_are_due_once_a_day(capsys):
    from datetime import UTC, datetime, timedelta

    from ledeforge.plans.schedule import next_digest, serve
    from ledeforge.sources.market import Settings

    s = Settings.load({"DIGEST_TIME": "08:30", "DIGEST_TZ": "Asia/Hong_Kong"})
    utc = lambda *a: datetime(*a, tzinfo=UTC)
    assert next_digest(utc(2026, 1, 1, 0, 0), s) == utc(2026, 1, 1, 0, 30)
    assert next_digest(utc(2026, 1, 1, 0, 30), s) == utc(2026, 1, 2, 0, 30)
    ny = Settings.load({"DIGEST_TIME": "2:30", "DIGEST_TZ": "America/New_York"})
    assert next_digest(utc(2026, 3, 7, 12, 0), ny) - utc(2026, 3, 8, 0, 0) < timedelta(hours=9)  # the night that the clock skips it
    now, seen = [utc(2026, 1, 1, 0, 0)], []

    def nap(seconds):
        now[0] += timedelta(seconds=seconds)

    def digest(at):
        seen.append(("digest", at))
        now[0] += timedelta(hours=1)  # a long run
        raise OSError("and a broken one")

    ran = serve(digest, lambda at: seen.append(("alerts", at)), s, utc(2026, 1, 1, 2, 0), lambda: now[0], nap)
    assert ran == len(seen) and [w for w, _ in seen].count("digest") == 1
    assert [at.minute for w, at in seen if w == "alerts"][:3] == [1, 16, 30]
    assert "a run failed" in capsys.readouterr().out


def test_command_line(spark, capsys):
    from ledeforge.__main__ import main

    assert main(["--demo", "--categories", "macro, nonsense", "--depth", "data"], spark) == 0
    out = capsys.readouterr().out
    assert "Fed holds rates steady" in out and "Solana" not in out and "█" in out


def test_chats_share_rankings_until_they_change_their_settings(spark, tmp_path):
    from ledeforge.operators.readers import rank_signatures
    from ledeforge.plans import ranking, requests
    from ledeforge.sources.market import PrefsStore

    items = spark.createDataFrame([(k, f"Story {k}", ["macro", "flows"][k % 2], "crypto", None, *([k / 20] * 8)) for k in range(12)], "seq long, title string, category string, bucket string, subject string, " + ", ".join(f"raw_{f} double" for f in V.FACTOR_WEIGHTS))
    asked_for = []

    def rank(signs):
        asked_for.append(sorted(r["signature"] for r in signs.collect()))
        return rank_signatures(items, signs, *ranking.limits(F.col("bucket")))

    store, cache = PrefsStore(spark, f"{tmp_path}/prefs"), RankingCache(spark, f"{tmp_path}/cache")
    store.update(spark.createDataFrame([("1", ["macro"], "data"), ("2", ["macro"], "data"), ("3", ["flows"], "data")], "chat_id string, categories array<string>, depth string"), at("2026-01-01"))
    chats = spark.createDataFrame([("1",), ("2",), ("3",), ("9",), ("1",)], "chat_id string")

    def get(now):
        out = {}
        for r in requests.rankings(chats, store, cache, rank, at(now)).orderBy("chat_id", "rank").collect():
            out.setdefault((r["chat_id"], r["hit"]), []).append(r["seq"])
        return out

    everything = f"{','.join(sorted(V.CATEGORIES))}|balanced"
    first = get("2026-01-01 00:00:00")
    assert first[("1", False)] == first[("2", False)] == [10, 8, 6, 4, 2, 0] and first[("3", False)][0] == 11 and first[("9", False)] == [11, 10, 9, 8, 7, 6]
    assert asked_for == [sorted(["flows|data", everything, "macro|data"])]
    assert {k[1] for k in get("2026-01-01 00:19:00")} == {True} and len(asked_for) == 1
    act = lambda *r: spark.createDataFrame(r, "chat_id string, action string")
    assert requests.change_settings(act(("1", "nonsense"), ("2", "depth:data"), ("3", "cat:bogus")), store, cache, at("2026-01-01 00:19:10")).count() == 0
    changed = requests.change_settings(act(("1", "cat:flows"), ("2", "cat:macro")), store, cache, at("2026-01-01 00:19:20")).collect()
    # a chat that turns its last category off has all of them
    assert {r["chat_id"]: r["categories"] for r in changed} == {"1": ["flows", "macro"], "2": sorted(V.CATEGORIES)}
    again = get("2026-01-01 00:19:30")
    assert again[("1", False)] == first[("9", False)] and ("2", False) in again and again[("3", True)] == first[("3", False)]
    assert {k[1] for k in get("2026-01-01 00:20:00")} == {True, False}  # the first rankings are too old now, the others are not
