"""Language identification by word-first backoff.

A word that was seen in training scores by its log frequency in each language.
An unseen word is read as character n-grams: at each position the longest known
one speaks, and shorter ones only where no longer one is known. Counts are
gathered by Spark over a bounded sample of documents; the tables have bounded
sizes, so they can be broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.quality_model import fold

#: Documented bounds, parameters of the fit: documents it takes, about, by hash of their id; words and n-grams kept (None: all).
FIT_DOCS = 20_000
MAX_WORDS = 40_000
MAX_GRAMS = 60_000
LONGEST = 4
FOLDS, HELD_OUT = 3, 1
UND = "und"
CACHE_WORDS = 200_000
#: Words are runs of letters, in training and prediction alike.
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class LanguageTables:
    """Log frequencies by language, a row each for words and n-grams."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_rows: np.ndarray
    gram_rows: np.ndarray
    floor: np.ndarray

    def word(self, w: str) -> np.ndarray:
        k = self.words.get(w)
        if k is not None:
            return self.word_rows[k]
        padded, rows, i = f" {w} ", [], 0
        while i < len(padded):
            for n in range(min(LONGEST, len(padded) - i), 0, -1):
                k = self.grams.get(padded[i : i + n])
                if k is not None:
                    rows.append(self.gram_rows[k])
                    break
            i += 1
        return np.mean(rows, axis=0) if rows else self.floor


class WordScores(dict):
    """Row numbers by word into a growing matrix, kept up to a number of words."""

    def __init__(self, tables: LanguageTables, limit: int = CACHE_WORDS):
        super().__init__()
        self.tables, self.limit = tables, limit
        self.rows = np.zeros((1024, len(tables.langs)))

    def __missing__(self, w: str) -> int:
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.tables.word(w)
        self[w] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        found = LETTERS.findall(text.lower()) if text else []
        if not found or not self.tables.langs:
            return UND, 0.0
        total = np.zeros(len(self.tables.langs))
        for lo in range(0, len(found), self.limit):
            part = found[lo : lo + self.limit]
            if len(self) + len(part) > 2 * self.limit:
                self.clear()
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            total += self.rows[at].sum(axis=0)
        best = int(total.argmax())
        return self.tables.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, max_words: int | None = MAX_WORDS, max_grams: int | None = MAX_GRAMS) -> LanguageTables:
    """Counts words by language in rows outside the held-out fold whose language is known.

    Beyond ``fit_docs`` rows, ids are taken by hash at the rate that gives
    about so many. ``max_words`` words and ``max_grams`` n-grams are kept by
    frequency, ties by name; a word beyond them is read as n-grams. Repeated
    rows count each; null ids, as the empty id's fold, are learned from.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id", FOLDS) != HELD_OUT))
    total = rows.count()
    if total > fit_docs:
        rows = rows.filter(F.pmod(F.xxhash64(F.col("id"), F.lit("fit")), F.lit(1 << 40)) < int((1 << 40) * fit_docs / total))
    spoken = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    top = spoken.groupBy("w").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("all"), "w")
    top = top if max_words is None else top.limit(max_words)
    return build_tables([(r["w"], r["by"]) for r in top.collect()], max_grams)  # the words of fit_docs documents at most


def build_tables(counted: list[tuple[str, dict[str, int]]], max_grams: int | None = MAX_GRAMS) -> LanguageTables:
    langs = sorted({k for _, by in counted for k in by})
    col = {k: i for i, k in enumerate(langs)}
    counts = np.zeros((len(counted), len(langs)))
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for k, (w, by) in enumerate(counted):
        for lang, n in by.items():
            counts[k, col[lang]] = n
        padded = f" {w} "
        for i in range(len(padded)):
            for n in range(1, min(LONGEST, len(padded) - i) + 1):
                grams[padded[i : i + n]] += counts[k]
    kept = sorted(grams, key=lambda g: (-grams[g].sum(), g))[:max_grams]

    def logs(table: np.ndarray) -> np.ndarray:
        return np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(1, len(table)))) if len(table) else table

    gram_counts = np.stack([grams[g] for g in kept]) if kept else np.zeros((0, len(langs)))
    floor = np.full(len(langs), np.log(1e-9))
    return LanguageTables(langs, {w: k for k, (w, _) in enumerate(counted)}, {g: k for k, g in enumerate(kept)}, logs(counts), logs(gram_counts), floor)


def identify_language(docs: DataFrame, tables: LanguageTables, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the winner's posterior) to every row.

    Null text and text without a letter are ``und`` with score 0, as is all
    text where no language was learned. Ties go to the first language by name.
    The two names are replaced where the input has them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # MAX_WORDS + MAX_GRAMS rows

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for texts in batches:
            yield pd.DataFrame([scores.predict(t) for t in texts], columns=["lang_pred", "score"])

    udf = F.pandas_udf(predict, "lang_pred string, score double")
    keep = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*keep, udf(F.col(text_col)).alias("_found"))
    return out.select(*keep, "_found.lang_pred", "_found.score")
