"""What readers are sent: the top list and the digest, of all signatures at once.

A view is a set of numbered blocks for each signature; ``assemble`` packs them
into messages. Readers join the messages of their signature, so a message is
composed once however many read it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.functions import render
from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import age_hours
from ledeforge.functions.text import html_escape
from ledeforge.operators.assemble import assemble
from ledeforge.operators.readers import signature

# ---- places of blocks in a view: lists start at the round numbers ----
HEAD, OPENING, STORY, BULLETS, CLOSING, SOURCES, ENTRIES, AFTER = 0, 1, 2, 100, 900, 901, 1000, 2000
EMPTY_TOP = "🏆 <b>Top stories</b>\n\nNothing in your categories in the last 24 hours.\n\n<i>Widen them in your settings.</i>"
NO_STORY = "No qualifying stories in the window"
NO_MODEL = "<i>⚠️ No model answered: ranked headlines only</i>"
TOP_FOOT = "<i>The digest has the written briefing.</i>"


def _block(rows: DataFrame, at: Column | int, text: Column | str) -> DataFrame:
    at = F.lit(at) if isinstance(at, int) else at
    return rows.select("signature", at.cast("int").alias("ord"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).filter(F.col("text") != "")


def _notes(signs: DataFrame, ranked: DataFrame, pools: DataFrame) -> DataFrame:
    """(signature, ..., n, scope, depth_said) of every signature, with a count of its stories and the two remarks."""
    carries = lambda f: F.count_if(F.col(f"raw_{f}") > 0)
    counts = ranked.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), carries("numeric").alias("numeric"), carries("analysis").alias("analysis"))
    rows = signs.join(counts, "signature", "left").join(pools, "signature", "left").fillna(0, ["n", "numeric", "analysis"])
    carried = F.when(F.col("depth") == "analysis", F.col("analysis")).otherwise(F.col("numeric"))
    return rows.withColumns({"scope": render.scope_note(F.col("categories"), F.col("pool_before"), F.col("pool_after")), "depth_said": render.depth_note(carried, F.col("n"), F.col("depth"))})


def top_blocks(signs: DataFrame, ranked: DataFrame, pools: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """(signature, ord, text) of the top lists: up to ``limit`` stories between a head, remarks and the legend. Without stories, only a hint."""
    noted = _notes(signs, ranked, pools)
    some, none = noted.filter("n > 0"), noted.filter("n = 0")
    label = F.element_at(F.create_map(*(F.lit(x) for d, name in V.DEPTH_LABELS.items() for x in (d, name.lower()))), F.col("depth"))
    stories = ranked.filter(F.col("rank") <= limit)
    fixed = [(OPENING, render.RULE), (AFTER, render.RULE), (AFTER + 3, render.LEGEND), (AFTER + 4, TOP_FOOT)]
    return _union([
        _block(none, HEAD, EMPTY_TOP),
        _block(some, HEAD, F.concat(F.lit("🏆 <b>Top stories</b>\n<i>your weights · "), label, F.lit("</i>"))),
        *(_block(some, at, text) for at, text in fixed),
        _block(stories, F.col("rank") + ENTRIES, render.entry(F.col("rank"), age_hours(now))),
        _block(some, AFTER + 1, F.col("scope")), _block(some, AFTER + 2, F.col("depth_said")),
    ])


def digest_blocks(signs: DataFrame, ranked: DataFrame, pools: DataFrame, now: Column, market: Column, written: DataFrame, tz: str = V.DIGEST_TZ) -> DataFrame:
    """(signature, ord, text) of the digests: headline and bullets as ``written`` (signature, headline, bullets, llm_ok), every source, the market line, remarks and the legend.

    Without stories the digest says so, and no model is missed.
    """
    noted = _notes(signs, ranked, pools).join(written.select("signature", "headline", "llm_ok"), "signature", "left")
    some = noted.filter("n > 0")
    bullets = written.select("signature", F.posexplode("bullets").alias("k", "b"))
    head = F.concat(F.lit("📊 <b>Your briefing</b>\n<i>"), render.local_time(now, tz), F.lit("</i>"))
    return _union([
        _block(noted, HEAD, head), _block(noted, OPENING, render.RULE),
        _block(noted, STORY, F.concat(F.lit("<b>"), html_escape(F.coalesce("headline", F.lit(NO_STORY))), F.lit("</b>"))),
        _block(bullets, F.col("k") + BULLETS, F.concat(F.lit("▸ "), html_escape(F.col("b")))),
        _block(some, CLOSING, render.RULE), _block(some, SOURCES, "<b>Sources</b>"),
        _block(ranked, F.col("rank") + ENTRIES, render.entry(F.col("rank"), age_hours(now))),
        _block(noted, AFTER, render.RULE), _block(noted, AFTER + 1, market), _block(noted, AFTER + 2, render.RULE),
        _block(noted, AFTER + 3, F.col("scope")), _block(noted, AFTER + 4, render.LEGEND), _block(some.filter("NOT llm_ok"), AFTER + 5, NO_MODEL),
    ])


def messages(blocks: DataFrame, readers: DataFrame, limit: int = V.MESSAGE_LIMIT) -> DataFrame:
    """(chat_id, part, text): each reader's messages, composed once a signature."""
    composed = assemble(blocks, ["signature"], limit)
    return readers.select("chat_id", signature(F.col("categories"), F.col("depth")).alias("signature")).join(composed, "signature").select("chat_id", "part", "text")
