"""The corpus pipeline: quality, lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
has kept, and is written before the next reads it. An empty table passes
through as one. Columns beyond those of documents stay until packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeforge.llm.decontaminate import decontaminate, find_leaks
from ledeforge.llm.jaccard_join import jaccard_components
from ledeforge.llm.line_dedup import line_dedup
from ledeforge.llm.packing import PACK_WEIGHTS, pack
from ledeforge.llm.quality_model import fit_quality, quality_scores
from ledeforge.runtime import bounded_broadcast, materialize, release

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, doesn't reject. Null texts score as empty ones, rows that repeat an id each by their own; without labels nothing is rejected."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, model).filter(F.col("predicted") == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many share; one left without lines stays as empty text."""
    kept = line_dedup(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    Rows that repeat an id go together: all of them if any is linked to a smaller
    id, else all stay. Null ids and texts without words are linked with nothing and stay.
    """
    groups = jaccard_components(docs)
    copies = materialize(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    return docs.join(bounded_broadcast(copies), "doc_id", "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none; of rows that repeat an id, those go whose own text does."""
    return decontaminate(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences. A null text is one piece with the end id alone; repeated rows are pieces of their own."""
    import public_tokenizers

    packed = pack(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), keep_ids=False, weights=PACK_WEIGHTS)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontamination", leaks),
    ("packing", packing),
]

#: Trees and merges are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
