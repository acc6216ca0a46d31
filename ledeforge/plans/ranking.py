"""A ranking run: classify, dedupe, filter, score, select, merge, count."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.functions.render import clean_bullets, prompt_item
from ledeforge.functions.scoring import classify, primary_subject, score_items, title_and_tags, weights_for
from ledeforge.operators import stats
from ledeforge.operators.dedupe import dedupe
from ledeforge.operators.filters import category_filter
from ledeforge.operators.select import final_merge, select_top
from ledeforge.runtime import materialize


@dataclass
class RankingRun:
    """What a run gives: the selected items in order, all scored ones, and counts."""

    items: DataFrame
    scored: DataFrame
    merged: DataFrame
    counts: DataFrame
    signature: tuple


def by_score():
    """The order of a run's few selected items."""
    return Window.orderBy(F.desc("score"), "bucket_ord", "seq")


def limits(bucket: Column) -> tuple[Column, Column]:
    """(min, max) of a bucket; unknown buckets have macro's."""
    lo, hi = (F.when(bucket == "crypto", V.LIMITS["crypto"][k]).otherwise(V.LIMITS["macro"][k]) for k in (0, 1))
    return lo, hi


def run(items: DataFrame, now: Column, enabled: Iterable[str] | None = None, depth: str = "balanced", batch: Column | None = None) -> RankingRun:
    """Ranks kept items (seq, title, url, source, published_at, bucket, tags, summary).

    ``now`` is one frozen value for the whole run. Items are deduplicated within
    (batch, bucket) before the category filter, so corroboration counts over the
    whole feed, while thresholds apply to the reader's pool.
    """
    batch = F.lit(0) if batch is None else batch
    named = items.withColumn("category", classify(title_and_tags())).withColumn("group_", batch)
    # one key for batch and bucket, since dedupe never crosses either
    keyed = named.withColumn("batch", F.concat_ws("/", F.col("group_").cast("string"), "bucket"))
    merged = materialize(dedupe(keyed), "merged")
    pool = category_filter(merged, enabled)
    scored = score_items(pool, now, weights_for(depth)).withColumn("subject", primary_subject(F.col("title")))
    lo, hi = limits(F.col("bucket"))
    selected = select_top(scored.withColumns({"_lo": lo, "_hi": hi}), ["batch"], F.col("_lo"), F.col("_hi")).drop("_lo", "_hi")
    signature = (tuple(sorted(set(enabled))) if enabled else (), depth)
    return RankingRun(final_merge(selected), scored, merged, stats.bucket_rollup(items, merged, selected), signature)


def fallback_digest(items: DataFrame) -> DataFrame:
    """One row (headline, bullets, llm_ok) from ranked items (rank, title, source) without a model; no items is a digest of its own."""
    top = items.filter(F.col("rank") <= V.FALLBACK_BULLETS)
    made = top.agg(F.min_by("title", "rank").alias("headline"), F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("title", F.lit(" ("), "source", F.lit(")")).alias("b")))), lambda x: x["b"]).alias("bullets"))
    return made.select(F.coalesce("headline", F.lit("No qualifying stories in the window")).alias("headline"), "bullets", F.col("headline").isNull().alias("llm_ok"))


#: A model: from a prompt to its answer, as text. It may raise.
Model = Callable[[str], str]


def json_object(text: str | None) -> dict | None:
    """The JSON object that an answer is, fenced lines aside, or that its widest braces hold; None where neither is one."""
    kept = "\n".join(x for x in (text or "").splitlines() if not x.lstrip().startswith("```"))
    for tried in (kept, kept[kept.find("{") : kept.rfind("}") + 1]):
        try:
            found = json.loads(tried)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def ask_chain(prompts: DataFrame, models: Sequence[tuple[str, Model]], col: str = "prompt") -> DataFrame:
    """``prompts`` with ``model`` and ``answer``, the first of ``models`` whose answer holds a JSON object and that object's text, and ``failed``, those before it.

    Models are asked row by row where the rows are. None raises out of it: a row
    that no model answers has nulls and all names in ``failed``.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for prompt in b.column(col).to_pylist():
                failed, row = [], (None, None)
                for name, model in models:
                    try:
                        found = json_object(model(prompt))
                    except Exception:  # whatever a model does, the next one is asked
                        found = None
                    if found is not None:
                        row = name, json.dumps(found, ensure_ascii=False)
                        break
                    failed.append(name)
                out.append((*row, failed))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*b.schema.names, "model", "answer", "failed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(ask, f"{schema}, model string, answer string, failed array<string>")


def digest_prompts(ranked: DataFrame, key: str) -> DataFrame:
    """(key, prompt): what a model is told about the first ranked items (key, rank, title, ...) of each key."""
    rows = ranked.filter(F.col("rank") <= V.DIGEST_BULLETS).select(key, "rank", prompt_item(F.col("rank")).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"])
    return rows.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("prompt"))


def fallback_digests(ranked: DataFrame, key: str) -> DataFrame:
    """(key, headline, bullets) without a model: the first title, and the first few with their sources."""
    top = ranked.filter(F.col("rank") <= V.FALLBACK_BULLETS)
    bullets = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("title", F.lit(" ("), "source", F.lit(")")).alias("b")))), lambda x: x["b"])
    return top.groupBy(key).agg(F.min_by("title", "rank").alias("headline"), bullets.alias("bullets"))


def digests(ranked: DataFrame, models: Sequence[tuple[str, Model]], key: str = "signature") -> DataFrame:
    """(key, headline, bullets, llm_ok, model, failed, invented) of every key with ranked items.

    An answer counts if it has a headline and bullets that are not blank; else the
    digest is the one without a model. ``invented`` lists the figures that a
    written digest has and its prompt doesn't, which a reader should not see unchecked.
    """
    said = ask_chain(digest_prompts(ranked, key), models)
    parsed = F.from_json("answer", "headline string, bullets array<string>")
    said = said.select(key, "prompt", "model", "failed", F.trim(parsed["headline"]).alias("h"), clean_bullets(F.coalesce(parsed["bullets"], F.array().cast("array<string>"))).alias("b"))
    usable = F.coalesce((F.col("h") != "") & (F.size("b") > 0), F.lit(False))
    rows = fallback_digests(ranked, key).join(said, key, "left").withColumn("llm_ok", usable)
    rows = rows.withColumns({"headline": F.when(F.col("llm_ok"), F.col("h")).otherwise(F.col("headline")), "bullets": F.when(F.col("llm_ok"), F.col("b")).otherwise(F.col("bullets"))})
    written = F.concat_ws("\n", "headline", F.array_join("bullets", "\n"))
    return rows.select(key, "headline", "bullets", "llm_ok", F.when(F.col("llm_ok"), F.col("model")).alias("model"), "failed", invented_numbers(written, F.col("prompt")).alias("invented"))


def digest(items: DataFrame, models: Sequence[tuple[str, Model]] = ()) -> DataFrame:
    """One row (headline, bullets, llm_ok) from ranked items; no items is a digest of its own."""
    made = digests(items.withColumn("_run", F.lit(0)), models, "_run").select("headline", "bullets", "llm_ok")
    empty = fallback_digest(items).filter("llm_ok").select("headline", F.coalesce("bullets", F.array().cast("array<string>")).alias("bullets"), "llm_ok")
    return made.unionByName(empty)


def invented_numbers(written: Column, source: Column) -> Column:
    """Figures in a written text that its source doesn't have, each once, as they come."""
    find = lambda c: F.regexp_extract_all(c, F.lit(r"(\d[\d,.]*\d|\d)"), F.lit(1))
    return F.array_except(find(written), find(source))
