"""The driver's queries over the corpus operators, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.line_dedup import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.decontaminate import find_leaks

    leaks = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.col("item").alias("item_id"), F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.round("similarity", 6).alias("similarity"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.quality_model import FOLDS, HELD_OUT, fit_quality, fold, quality_scores

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.url_filter import filter_urls, mine_rules

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine_rules(pages, _table(spark, sf_dir, "labels"))
    return filter_urls(pages, mined).select("page_id", "host", "path", "rule", "verdict")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.language_id import FOLDS, HELD_OUT, fit_languages, fold, identify_language

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, fit_languages(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.packing import PACK_WEIGHTS, pack

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, _vocabulary("byte_bpe_50k.json"), keep_ids=False, weights=PACK_WEIGHTS).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.token_count import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, _vocabulary("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.quality_rules import quality_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.importance import importance_sample

    drawn = importance_sample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.conversation_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledeforge.llm.simhash_trees import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_decontaminate, op3_jaccard_join, op4_quality_model, op5_url_filter, op6_language_id, op7_pack, op8_token_counts, op9_quality_rules, op10_substring_dedup, op11_importance_sample, op12_conversation_trie, op13_simhash_dedup)}
