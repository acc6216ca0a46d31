"""Importance resampling towards a target distribution.

Runs of words are hashed into a fixed number of buckets, and each bucket has an
integer gain: how much likelier the target is to use it than the corpus. Gains
stand in one array, by which a text is scored in a single look-up a run. A
Gumbel number drawn from the id alone turns weights into scores whose highest
are a sample without replacement.

Scores are integers within a narrow range, so their exact histogram has a size
that does not follow the corpus. Its suffix sums give each score's first rank and
the score at which the sample ends; only rows from there on are numbered, by id
within their score. Nothing is sorted as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.runtime import materialize

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Integer steps of a natural logarithm.
UNIT = 1000
CACHE_WORDS = 100_000
#: Words that a worker hashes at once, of however long a text.
CHUNK = 1 << 16
#: Digits, letters and what is beyond ASCII are parts of words; all else parts them.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


class _Crc(dict):
    """CRC-32 by word, kept up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_CRC = _Crc()


def feature_buckets(text: str | None, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> tuple[int, Iterator[np.ndarray]]:
    """(number of words, buckets of all runs of 1 to ``max_run`` words, in parts of bounded size)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()

    def parts() -> Iterator[np.ndarray]:
        for lo in range(0, len(words), CHUNK):
            some = words[lo : lo + CHUNK]
            yield np.fromiter(map(_CRC.__getitem__, some), np.int64, len(some)) % buckets
            for n in range(2, max_run + 1):
                ends = range(lo, min(lo + CHUNK, len(words) - n + 1))
                yield np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) for i in ends), np.int64, len(ends)) % buckets

    return len(words), parts()


def bucket_counts(texts: DataFrame, text_col: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows of ``texts``; each task sends one count a bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                for part in feature_buckets(t, max_run, buckets)[1]:
                    total += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row a bucket
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer log ratios of the target's smoothed share of each bucket to the source's."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    k = len(source)
    return np.floor(UNIT * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def importance_scores(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_run: int = MAX_RUN, seed: str = SEED) -> DataFrame:
    """(``id_col``, n_words, n_features, weight, score) of every row; the score is null where the id is.

    The weight is the mean gain of a text's features, rounded down; a text without
    words has weight 0. The score adds a Gumbel number that the seed and the id fix.
    """
    array = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = array.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                n_words, parts = feature_buckets(t, max_run, len(gain))
                n = total = 0
                for part in parts:
                    n, total = n + len(part), total + int(gain[part].sum())
                out.append((n_words, n, total // n if n else 0))
            numbers = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(numbers[:, k]) for k in range(3))], names=[id_col, "n_words", "n_features", "weight"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(weigh, f"`{id_col}` {kind}, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(UNIT)) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def top_share(scored: DataFrame, eligible, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... by score and then id for the best ``percent`` hundredths of the ``eligible`` rows, else null.

    ``scored`` has an integer ``score`` and must be cheap to read again. Rows that
    agree in all columns are counted before they are numbered, so that very many
    of them move as one; beyond that, ties go by the columns that follow.
    """
    may = eligible & F.col("score").isNotNull()
    # scores are integers between sums of logarithms of counts: some ten thousands, however many rows there are
    counts = {r["score"]: r["n"] for r in scored.filter(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = percent * sum(counts.values()) // 100
    order = sorted(counts, reverse=True)
    above = dict(zip(order, accumulate((counts[s] for s in order), initial=0), strict=False))
    kept = [s for s in order if above[s] < size]
    if not kept:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cutoff = kept[-1]
    offsets = scored.sparkSession.createDataFrame([(s, above[s]) for s in kept], "score long, above long")
    names = scored.columns
    beyond = scored.filter(~F.coalesce(may & (F.col("score") >= cutoff), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    alike = scored.filter(may & (F.col("score") >= cutoff)).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(offsets), "score")
    within = Window.partitionBy("score").orderBy(id_col, *(c for c in names if c not in ("score", id_col)))
    last = F.col("above") + F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    numbered = alike.withColumn("_last", last).select(*names, F.explode(F.sequence(F.col("_last") - F.col("_n") + 1, F.col("_last"))).alias("rank"))
    return numbered.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank"))).unionByName(beyond)


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(``id_col``, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with ``min_words`` words or more, the best ``percent`` hundredths
    by score are drawn and have a rank from 1; ties go to the smaller id. Null and
    empty texts have no words and weight 0. Rows with a null id count in the
    buckets, but have no score and are never drawn. Each row that repeats an id is
    scored by its own text; rows alike in everything take ranks side by side. An
    empty target leaves gains that only smooth the corpus, an empty corpus gives no rows.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, max_run, buckets), bucket_counts(target, target_col, max_run, buckets))
    scored = materialize(importance_scores(docs, gains, id_col, text_col, max_run, seed), "importance-scores")
    return top_share(scored, F.col("n_words") >= min_words, percent, id_col)
