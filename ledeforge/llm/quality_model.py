"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from a text's byte histogram and its words and lines. Trees are
grown on the driver over a bounded sample of labelled rows, on quantile bins
with a logistic loss, and flattened into arrays that a batch of documents
descends level by level in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit takes, about, by hash of their id: the documented bound of the training sample.
FIT_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_CLASSES = [
    np.array([chr(b).islower() and b < 128 for b in range(256)]),
    np.array([chr(b).isupper() and b < 128 for b in range(256)]),
    np.array([48 <= b < 58 for b in range(256)]),
    np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)]),
    np.array([b in b"#*$%&|<>" for b in range(256)]),
    np.array([b in b"!?" for b in range(256)]),
    np.array([b in b".,;:" for b in range(256)]),
    np.array([b in b"@/\\_=+~^`{}[]()\"'" for b in range(256)]),
    np.array([b >= 128 for b in range(256)]),
    np.array([b < 32 and b not in b"\t\n\r" for b in range(256)]),
    np.array([b == 10 for b in range(256)]),
    np.array([b == 124 for b in range(256)]),
]
_CLASS_MATRIX = np.stack(_CLASSES, axis=1).astype(np.float64)
N_FEATURES = len(_CLASSES) + 11


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row of statistics a text; null is as empty."""
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode("utf-8", "replace")
        n = len(raw)
        words = raw.split()
        nw = len(words)
        row[0] = np.log1p(n)
        row[1] = np.log1p(nw)
        if not nw:
            continue
        hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        row[11:] = hist @ _CLASS_MATRIX / n
        times = Counter(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        top = times.most_common(2)
        row[2] = sum(map(len, words)) / nw
        row[3] = len(times) / nw
        row[4] = top[0][1] / nw
        row[5] = top[-1][1] / nw
        row[6] = len(set(lines)) / len(lines)
        row[7] = nw / len(lines)
        row[8] = len(times) / np.sqrt(nw)
        row[9] = np.log1p(max(map(len, words)))
        share = hist[hist > 0] / n
        row[10] = -(share * np.log2(share)).sum()
    return out


@dataclass
class Trees:
    """All trees in one set of arrays: a node is a leaf where its left child is itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_rows: int = 5) -> Trees:
    """Boosts ``trees`` trees of ``depth`` on ``bins`` quantile bins; without rows the score is 0.5 everywhere."""
    n, width = x.shape
    rate_up = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_up / (1 - rate_up)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    if not n:
        trees = 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)] if n else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else x
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        root = add(rate * g.sum() / (h.sum() + l2))
        roots.append(root)
        at, open_ = np.full(n, root), [root]
        for _ in range(depth):
            slot = np.full(len(nodes["value"]), -1)
            slot[open_] = np.arange(len(open_))
            where = slot[at]
            live = where >= 0
            best = np.full((len(open_), 3), -np.inf)  # gain, feature, bin
            if not live.any():
                break
            w, gl, hl = where[live], g[live], h[live]
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = w * bins + binned[live, f]
                shape = (len(open_), bins)
                gs, hs, cs = (np.bincount(key, weights=v, minlength=shape[0] * bins).reshape(shape).cumsum(axis=1) for v in (gl, hl, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(cs < min_rows) | (ct - cs < min_rows)] = -np.inf
                gain = gain[:, : len(e)]
                top = gain.argmax(axis=1)
                value = gain[np.arange(len(open_)), top]
                better = value > best[:, 0]
                best[better] = np.stack([value, np.full(len(open_), f), top], axis=1)[better]
            grown = []
            for k, node in enumerate(open_):
                gain, f, b = best[k]
                if not gain > 1e-6:
                    continue
                f, b = int(f), int(b)
                mine = at == node
                low = mine & (binned[:, f] <= b)
                sides = [add(rate * g[m].sum() / (h[m].sum() + l2)) for m in (low, mine & ~low)]
                nodes["feature"][node], nodes["threshold"][node], nodes["left"][node], nodes["right"][node] = f, edges[f][b], *sides
                at[low], at[mine & ~low] = sides
                grown += sides
            open_ = grown
            if not open_:
                break
        margin += np.array(nodes["value"])[at]
    arrays = {k: np.array(v, dtype=np.int64 if k in ("feature", "left", "right") else np.float64) for k, v in nodes.items()}
    return Trees(**arrays, roots=np.array(roots, dtype=np.int64), depth=depth, base=base)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, by ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Learns ``label_col`` from labelled documents outside the held-out fold, from text alone.

    ``fit_rows`` bounds the sample that reaches the driver: beyond it, ids are
    taken by hash at the rate that gives about so many. A document with several
    labels counts with their mean; null labels and null texts are left out.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT)).groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("_y"))
    total = known.count()
    if total > fit_rows:
        known = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 40)) < int((1 << 40) * fit_rows / total))
    known = known.withColumnRenamed(id_col, "_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = text_features(b["text"].tolist())
            yield pd.DataFrame({"id": b["id"].astype(str), "y": b["y"], "x": list(x)})

    # the sample is bounded by fit_rows, so this side may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(known), F.col("id") == F.col("_id")).select("id", "text", F.col("_y").alias("y"))
    got = rows.mapInPandas(features, "id string, y double, x array<double>").toPandas()
    if not len(got):
        return fit_trees(np.zeros((0, N_FEATURES)), np.zeros(0))
    got = got.sort_values("id", kind="stable")
    return fit_trees(np.stack(got["x"].to_list()), got["y"].to_numpy())


def quality_scores(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` and ``predicted`` to every row; null text scores as empty text.

    The two names are replaced where the input has them.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(text_features(texts.tolist())))

    udf = F.pandas_udf(score, "double")
    keep = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, udf(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
