"""Line dedup: drop lines that many documents share, keep one copy of each.

Lines are exploded as 128-bit hashes of their normalised form, documents are
counted per hash with map-side combine, and only the positions to drop travel
back to the documents. The text itself is shuffled once, for the reassembly by
position. A line held by a third of all documents costs one counter per map
task in the count. The repeated lines are written before the positions are
joined with them: by broadcast up to a counted bound, where no position moves,
and beyond it by a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.text import ascii_lower, lines, strip_ws
from ledeforge.runtime import bounded_broadcast, materialize

MIN_CHARS = 20
MIN_DOCS = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Adds ``kept_text``, ``n_lines`` and ``n_dropped`` to every row of ``docs``.

    A line's key is the line stripped of white space at both ends with A-Z
    lower-cased. Keys of at least ``min_chars`` code points held by at least
    ``min_docs`` rows lose all their lines but those in the largest id that
    holds them. Null or empty text is one empty line. Every row is a document
    of its own; a null id sorts below every other, and rows that share the
    largest id all keep their lines. Other columns pass unchanged. The names
    ``kept_text``, ``n_lines`` and ``n_dropped`` are replaced where the input
    has them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = (F.xxhash64("k").alias("a"), F.xxhash64(F.lit(7), "k").alias("b"))
    per_doc = F.array_distinct(F.filter(F.transform(lines(F.col(text_col)), strip_ws), lambda x: F.char_length(x) >= min_chars))
    held = (
        docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(F.transform(per_doc, ascii_lower))).alias("k"))
        .select("doc", *key)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("owner"))
        .filter(F.col("n") >= min_docs)
        .select("a", "b", "owner")
    )
    held = bounded_broadcast(materialize(held, "line-owners"))
    at = (
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("digest"), F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
        .withColumn("line", strip_ws(F.col("line")))
        .filter(F.char_length("line") >= min_chars)
        .select("doc", "digest", "pos", ascii_lower(F.col("line")).alias("k"))
        .select("doc", "digest", "pos", *key)
    )
    drops = (
        at.join(held, ["a", "b"])
        .filter(~F.col("doc").eqNullSafe(F.col("owner")))
        .groupBy("doc", "digest")
        .agg(F.collect_set("pos").alias("drop_at"))
    )
    # the row under names that can't clash; its lines are split before the join, so that picking by position is one look-up each
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("dg"), lines(F.col(text_col)).alias("ls"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("doc")) & (F.col("dg") == F.col("digest")), "left")
    n = F.size("ls")
    kept_at = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop_at"))
    kept = F.when(F.col("drop_at").isNull(), F.array_join("ls", "\n")).otherwise(F.array_join(F.transform(kept_at, lambda i: F.get("ls", i)), "\n"))
    new = ("kept_text", "n_lines", "n_dropped")
    return joined.select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new),
        kept.alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("drop_at"), F.lit(0)).cast("long").alias("n_dropped"),
    )
