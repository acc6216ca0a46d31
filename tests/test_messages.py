"""Messages: assembly, views, the model chain and rankings by signature."""

import random

import pytest
from pyspark.sql import functions as F

from ledeforge.functions import render
from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import total, weights_for
from ledeforge.operators import readers as R
from ledeforge.operators.assemble import assemble
from ledeforge.operators.filters import cap_per_source, category_filter
from ledeforge.operators.select import select_top
from ledeforge.plans import messages, ranking


def now():
    return F.lit("2026-08-21 12:00:00").cast("timestamp")


def packed(blocks, limit):
    out = []
    for b in (b[k : k + limit] for b in blocks for k in range(0, len(b), limit)):
        if out and len(out[-1]) + 2 + len(b) <= limit:
            out[-1] += "\n\n" + b
        else:
            out.append(b)
    return out


def test_assembly_against_a_loop(spark):
    rng, rows, want = random.Random(2), [], {}
    for key in range(60):
        blocks = ["".join(rng.choice("ab \n") for _ in range(rng.choice([1, 3, 10, 28, 30, 31, 75]))) for _ in range(rng.randrange(0, 40))]
        want |= {(key, k): t for k, t in enumerate(packed(blocks, 30))}
        rows += [(key, k, b) for k, b in enumerate(blocks)] + [(key, 1000, ""), (key, 1001, None)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys and messages go across batches
    try:
        got = {(r["key"], r["part"]): r["text"] for r in assemble(spark.createDataFrame(rows, "key long, ord int, text string"), ["key"], 30).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert assemble(spark.createDataFrame([], "key long, ord int, text string"), ["key"]).count() == 0


def test_assembly_agrees_with_splitting(spark):
    blocks = ["x" * n for n in (4000, 90, 4, 5000, 4096, 1, 2000, 2093)]
    df = spark.createDataFrame([(0, k, b) for k, b in enumerate(blocks)], "key int, ord int, text string")
    whole = spark.createDataFrame([("\n\n".join(blocks),)], "t string").select(F.explode(render.split_messages(F.col("t"))).alias("p"))
    assert [r["text"] for r in assemble(df, ["key"]).orderBy("part").collect()] == [r["p"] for r in whole.collect()]


def stories(spark, n=40):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        raw = [rng.choice([0.0, 0.35, 0.5, 0.75, 1.0]) for _ in V.FACTOR_WEIGHTS]
        rows.append((k, f"Story {k} <&> more", f"https://x.org/{k}?a=1&b=2", "CNBC", 1 + k % 3, rng.choice([*V.CATEGORIES, None]), rng.choice(["bitcoin", "xrp", None, None]), rng.choice(["crypto", "macro"]), "long " * k, *raw))
    names = ", ".join(f"raw_{f} double" for f in V.FACTOR_WEIGHTS)
    df = spark.createDataFrame(rows, f"seq long, title string, url string, source string, source_count int, category string, subject string, bucket string, summary string, {names}")
    return df.withColumn("published_at", now() - F.expr("make_dt_interval(0, 1)") * F.col("seq").cast("int"))


READERS = [("all", sorted(V.CATEGORIES), "balanced"), ("too", sorted(V.CATEGORIES), "balanced"), ("one", ["macro"], "data"), ("two", ["flows", "security"], "analysis")]


def run(spark, items):
    readers = spark.createDataFrame(READERS, "chat_id string, categories array<string>, depth string")
    signs = R.signatures(readers)
    lo, hi = ranking.limits(F.col("bucket"))
    return readers, signs, R.rank_signatures(items, signs, lo, hi), R.signature_pools(items, signs)


def test_a_signature_ranks_as_its_reader_alone(spark):
    items = stories(spark, 400)
    _, signs, ranked, pools = run(spark, items)
    got = {}
    for r in ranked.orderBy("signature", "rank").collect():
        got.setdefault(r["signature"], []).append(r["seq"])
    assert signs.count() == 3 and set(got) == {r["signature"] for r in signs.collect()}
    lo, hi = ranking.limits(F.col("bucket"))
    for _, cats, depth in READERS[1:]:
        mine = category_filter(items, cats).withColumns({"score": total(weights_for(depth)), "_lo": lo, "_hi": hi})
        alone = select_top(mine, ["bucket"], F.col("_lo"), F.col("_hi")).orderBy(F.desc("score"), "bucket", "seq")
        assert got[f"{','.join(cats)}|{depth}"] == [r["seq"] for r in alone.collect()]
    counts = {r["signature"]: (r["pool_before"], r["pool_after"]) for r in pools.collect()}
    assert counts["macro|data"] == (400, items.filter("category = 'macro'").count()) and counts[f"{','.join(sorted(V.CATEGORIES))}|balanced"] == (400, 400)


def test_views_hold_every_story_within_the_limit(spark):
    readers, signs, ranked, pools = run(spark, stories(spark))
    ranked = ranked.cache()
    blocks = messages.digest_blocks(signs, ranked, pools, now(), F.lit("<i>m</i>"), ranking.digests(ranked, []))
    sent = messages.messages(blocks, readers).orderBy("chat_id", "part").collect()
    assert {r["chat_id"] for r in sent} == {r[0] for r in READERS}
    for r in sent:
        assert len(r["text"]) <= V.MESSAGE_LIMIT
        assert all(r["text"].count(f"<{t}>") == r["text"].count(f"</{t}>") for t in ("b", "i", "code"))
    n = {r["signature"]: r["count"] for r in ranked.groupBy("signature").count().collect()}
    for chat, cats, depth in READERS:
        whole = "\n\n".join(r["text"] for r in sent if r["chat_id"] == chat)
        assert whole.count("<a href=") == n[f"{','.join(cats)}|{depth}"] and render.LEGEND in whole and messages.NO_MODEL in whole
        assert ("Filtered to" in whole) == (len(cats) < 5)
    top = {r["chat_id"]: r["text"] for r in messages.messages(messages.top_blocks(signs, ranked, pools, now(), 3), readers).collect()}
    assert top["all"] == top["too"] and top["all"].count("<a href=") == 3 and "Top stories" in top["one"]


def test_views_without_stories(spark):
    readers, signs, ranked, pools = run(spark, stories(spark).filter("category = 'flows'"))
    top = {r["chat_id"]: r["text"] for r in messages.messages(messages.top_blocks(signs, ranked, pools, now()), readers).collect()}
    assert top["one"] == messages.EMPTY_TOP and "<a href=" in top["two"]
    blocks = messages.digest_blocks(signs, ranked, pools, now(), F.lit("<i>m</i>"), ranking.digests(ranked, []))
    digest = {r["chat_id"]: r["text"] for r in messages.messages(blocks, readers).collect()}
    assert messages.NO_STORY in digest["one"] and messages.NO_MODEL not in digest["one"]


def test_alert_why_and_settings(spark):
    from ledeforge.functions.scoring import breakdown

    rows = stories(spark, 3)
    weights = weights_for()
    rows = rows.withColumns({f"why_{f}": F.lit(f"because {f}") for f in weights}).withColumns({"score": total(weights), "breakdown": breakdown(weights)})
    for r in rows.select(render.alert_text(F.lit(2.0), F.lit(0.6)).alias("a"), render.why_text(F.lit(3), F.lit(2.0)).alias("w"), F.round("score", 2).alias("s")).collect():
        assert "alert level of 0.60" in r["a"] and "instead of waiting" in r["a"] and "&lt;&amp;&gt;" in r["a"]
        assert all(f in r["w"] for f in weights) and "TOTAL" in r["w"] and "What drove it" in r["w"] and "Why #3" in r["w"]
    one = spark.createDataFrame([(["macro"], "data")], "c array<string>, d string")
    text = one.select(render.settings_text(F.col("c"), F.col("d"), {d: weights_for(d) for d in V.DEPTH_SPLITS}).alias("t")).first()["t"]
    assert text.count("🟢") == 1 and text.count("⚪️") == 4 and "numeric        0.170  ←" in text and "Numbers" in text


def test_remarks_and_lines(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    cats = lambda *c: F.array(*map(F.lit, c)).cast("array<string>")
    assert get(render.scope_note(cats(*V.CATEGORIES), F.lit(5), F.lit(5))) == "" == get(render.scope_note(cats(), F.lit(5), F.lit(5)))
    assert get(render.scope_note(cats("macro"), F.lit(9), F.lit(4))).startswith("<i>Filtered to 📉 Macro — 4 of 9")
    assert get(render.depth_note(F.lit(1), F.lit(8), F.lit("data"))).startswith("<i>Only 1 of 8")
    assert get(render.depth_note(F.lit(4), F.lit(8), F.lit("data"))) == "" == get(render.depth_note(F.lit(0), F.lit(8), F.lit("balanced")))
    prices = F.expr("array(named_struct('symbol', 'BTC', 'price', 70000.5D, 'change_pct', -1.25D))")
    assert get(render.market_line(prices, F.lit(55), F.lit("Greed"))) == "<b>BTC</b>  $70,000  ▼ 1.3%\n\n<i>Fear &amp; Greed 55 · Greed</i>"
    assert get(render.market_prompt(prices, F.lit(None).cast("int"), F.lit(None).cast("string"))) == "BTC $70,000.50 (-1.25% 24h)"
    assert get(render.attribution(F.lit("A&B"), F.lit(3), F.lit(30.0))) == "A&amp;B · +2 outlets agree · 1d ago"
    assert get(render.clean_bullets(cats(" a ", " ", "", "1b1"))) == ["a", "1b1"]
    assert len(get(render.clip(F.repeat(F.lit("x\n"), 5000)))) <= V.MESSAGE_LIMIT
    assert [x[:7] for x in render.weight_lines(V.FACTOR_WEIGHTS)[:3]] == ["keyword", "recency", "source_"]


def test_models_fall_through(spark):
    def broken(prompt):
        raise OSError("down")

    def picky(prompt):
        return "nothing" if "2" in prompt else '```json\n{"headline": "H 77", "bullets": [" one ", ""]}\n```'

    prompts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, None)], "id int, prompt string")
    chain = [("broken", broken), ("picky", picky), ("list", lambda p: "[1, 2]"), ("last", lambda p: 'so {"a": {"b": 1}} it is')]
    got = {r["id"]: (r["model"], r["failed"]) for r in ranking.ask_chain(prompts, chain).collect()}
    assert got == {1: ("picky", ["broken"]), 2: ("last", ["broken", "picky", "list"]), 3: ("last", ["broken", "picky", "list"])}
    assert [r["model"] for r in ranking.ask_chain(prompts, chain[:1]).collect()] == [None] * 3
    rows = spark.createDataFrame([(1, "First 5%", "A", "crypto", 1, "", 0.5, "k"), (2, "Second", "B", "crypto", 2, "s", 0.4, "k")], "rank int, title string, source string, bucket string, source_count int, summary string, score double, signature string")
    d = ranking.digests(rows, [("m", lambda p: '{"headline": "H 77", "bullets": ["x 5", " "]}')]).first()
    assert (d["headline"], d["bullets"], d["llm_ok"], d["model"], d["invented"]) == ("H 77", ["x 5"], True, "m", ["77"])
    d = ranking.digests(rows, [("m", lambda p: '{"headline": "H", "bullets": [" "]}')]).first()
    assert (d["headline"], d["bullets"], d["llm_ok"], d["model"], d["invented"]) == ("First 5%", ["First 5% (A)", "Second (B)"], False, None, [])


@pytest.mark.parametrize("cap", [1, 3])
def test_source_cap_against_a_loop(spark, cap):
    rng, rows, want = random.Random(cap), [], []
    for k in range(120):
        rows.append((k, rng.choice(["a", "b", "c", None]), rng.choice([None, None, "clickbait"])))
    for s in ("a", "b", "c", None):
        kept = 0
        for seq, src, reject in rows:
            if src == s and kept < cap:
                want.append(seq)
                kept += reject is None
    got = cap_per_source(spark.createDataFrame(rows, "seq long, source string, reject string"), cap).collect()
    assert sorted(r["seq"] for r in got) == sorted(want)


def test_selection_is_cut_before_it_is_walked(spark):
    plan = select_top(stories(spark).withColumn("score", F.col("raw_keyword")), ["bucket"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
