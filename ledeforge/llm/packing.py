"""Best-fit packing of token pieces into fixed-length sequences.

Every document becomes token ids and an end id; only longer ones are cut, into
full pieces with the shorter one first. A bin has three capacities: tokens,
documents and attention cost (the sum of squared piece lengths). An open bin
takes the piece whose share of the capacities has the largest weighted dot
product with what the bin has left (or leaves the smallest weighted residual
norm), among those that fit under every constraint.

Pieces of one length are alike to the bins, so bins are planned on the counts by
length, at most ``max_tokens`` of them whatever the corpus, as patterns with
multiplicities: each pattern uses up at least one length. Pieces then find
their slot by their rank within their length, with ranks dealt in small blocks,
so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.llm.workers import tidy
from ledeforge.runtime import materialize

MAX_TOKENS = 2048
CACHE_WORDS = 100_000
CACHE_CHARS = 64
#: Weights of tokens, documents and attention in the production queries; they reach the token lower bound of sequences on the given tables.
PACK_WEIGHTS = (1.0, 0.5, 0.5)
#: Pieces of one length that one task ranks, at most about.
BLOCK_ROWS = 20_000


#: A fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SELF} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SELF)}
GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ChunkIds(dict):
    """Little-endian ids by chunk, for vocabularies without the quicker encoder; a chunk has its space or newline in front."""

    def __init__(self, vocabulary: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(vocabulary), limit
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.short = self._short(spec)

    @staticmethod
    def _short(spec: dict):
        """A quicker encoder of the same merges, where the vocabulary is plain byte-level; ranks are ids there."""
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            return None
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            return None
        import tiktoken

        ranks = {bytes(_BYTE_OF[c] for c in t): k for t, k in vocab.items()}
        return tiktoken.Encoding("short", pat_str=GPT2_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        if self.short is not None and not any(s in text for s in self.special):
            return np.array(self.short(text), dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.whole(chunk) if chunk[:1] == "\n" else self.whole(" " + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Where white space is single spaces and newlines between words, a chunk's ids don't depend on its neighbours.

        The quicker encoder takes whole texts in less time than their chunks can be looked up in.
        """
        if self.short is not None or text.replace("\n", " ").split(" ") != text.split():
            return self.whole(text)
        chunks = text.replace("\n", " \n").split(" ")
        return b"".join([self.whole(chunks[0]), *map(self.__getitem__, chunks[1:])])


@functools.lru_cache(maxsize=2)
def chunk_ids(vocabulary: str) -> ChunkIds:
    """One table a worker process, kept from task to task."""
    return ChunkIds(vocabulary)


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """(``id_col``, piece, start, length, ids) of every row; ``ids`` is little-endian unsigned 32-bit.

    Null text is empty and gives the end id alone. Special strings in a text
    are what the library makes of them. Every row is a document of its own.
    """
    kind = dict(docs.dtypes)[id_col]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = chunk_ids(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = (table.text(text) if text else b"") + end
                n = len(ids) // 4
                first = (n - 1) % max_tokens + 1
                at = 0
                for k, stop in enumerate(range(first, n + 1, max_tokens)):
                    out.append((None if pd.isna(doc) else doc, k, at, stop - at, ids[4 * at : 4 * stop]))
                    at = stop
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids"]).astype({"piece": "int32", "start": "int64", "length": "int64"})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(tidy(cut), f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def plan_bins(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "dot") -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces of that length in each bin), ...]), ...] for ``counts`` by length."""
    cap = np.array([max_tokens, max_docs or max_tokens, max_attention or max_tokens**2], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    size = np.array(sorted(counts, reverse=True), dtype=np.int64)
    left = np.array([counts[s] for s in size.tolist()], dtype=np.int64)
    need = np.stack([size, np.ones_like(size), size * size], axis=1)
    if (need > cap).any():
        raise ValueError("a piece is larger than an empty bin")
    plans = []
    while left.any():
        rest, free, pattern = cap.copy(), left.copy(), {}
        while True:
            ok = (free > 0) & (need <= rest).all(axis=1)
            if not ok.any():
                break
            at = np.flatnonzero(ok)
            share, room = need[at] / cap, rest / cap
            rank = share @ (w * room) if score == "dot" else -(((room - share) ** 2) @ w)
            k = at[int(np.argmax(rank))]
            pattern[k] = pattern.get(k, 0) + 1
            free[k] -= 1
            rest -= need[k]
        times = min(int(left[k]) // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= m * times
        plans.append((times, [(int(size[k]), m) for k, m in pattern.items()]))
    return plans


def assign_sequences(pieces: DataFrame, id_col: str = "doc_id", max_tokens: int = MAX_TOKENS, blocks: int | None = None, **constraints) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length``; sequences have no gaps.

    Ranks are dealt in ``blocks`` a length, by default so many that the pieces
    of a block would be ``BLOCK_ROWS`` if all had one length, and 256 at least.
    Pieces should be materialised, since they are read three times. Ties and
    repeated rows take different slots. An empty table stays empty.
    """
    spark = pieces.sparkSession
    blocks = blocks or max(256, -(-pieces.count() // BLOCK_ROWS))
    # the block follows the row, so that equal rows land together and their order doesn't matter
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(id_col, "piece"), F.lit(blocks)).cast("int"))
    sizes = materialize(dealt.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length: max_tokens at most
    segments, base = [], 0
    used: dict[int, int] = dict.fromkeys(counts, 0)
    for times, pattern in plan_bins(counts, max_tokens, **constraints):
        at = 0
        for length, m in pattern:
            segments.append((length, used[length], times, m, base, at))
            used[length] += m * times
            at += m * length
        base += times
    plan = spark.createDataFrame(segments, "length long, _from long, _times long, _each long, _base long, _at long")
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "_block").orderBy(F.col(id_col), "piece")) - 1
    ranked = dealt.withColumn("_rank", rank).join(starts, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    lo = F.array_sort(F.collect_list(F.struct("_from", "_times", "_each", "_base", "_at")))
    # a length has as many segments as patterns that use it, max_tokens at most; the plan has a bounded size
    per_length = plan.groupBy("length").agg(lo.alias("_segments"))
    found = ranked.join(F.broadcast(per_length), "length").withColumn("_s", F.element_at(F.filter("_segments", lambda s: s["_from"] <= F.col("_rank")), -1))
    k = F.col("_rank") - F.col("_s._from")
    each = F.col("_s._each")
    return found.select(
        *(f"`{c}`" for c in pieces.columns),
        (F.col("_s._base") + F.floor(k / each)).cast("long").alias("sequence_id"),
        (F.col("_s._at") + F.pmod(k, each) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, keep_ids: bool = True, **constraints) -> DataFrame:
    """Packs every row of ``docs``; one row a piece, with ids or only their CRC-32.

    Constraints: ``max_docs`` pieces and ``max_attention`` squared tokens a
    sequence, ``weights`` of (tokens, documents, attention) and ``score``
    (``dot`` or ``norm``). Null text is empty, and a null id stays null. Other
    columns of ``docs`` are not returned, since a row is a piece.
    """
    pieces = token_pieces(docs, vocabulary, id_col, text_col, max_tokens).withColumn("ids_crc32", F.crc32("ids"))
    pieces = materialize(pieces if keep_ids else pieces.drop("ids"), "pack-pieces")
    return assign_sequences(pieces, id_col, max_tokens, **constraints)


def crc32_of(ids: bytes) -> int:
    """The digest that the pieces carry, for tests."""
    return zlib.crc32(ids)
