"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols form a doubly linked list; a heap holds its mergeable pairs by
rank. Popping the lowest rank and linking around the right symbol is one merge,
so the count is initial symbols minus merges and no identifier is ever looked
up. Words repeat, so counts are kept per worker in a bounded table, and a text
is a sum over its words.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 300_000
CACHE_CHARS = 64


#: A fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SELF)}
LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
LATIN_PROBES = ("Don't 12 ab-C", "ÀÿßŁ ñ½²«x»!? \u00a0\u0085\x1c\x7f", "I'LL we'd 'Sx é's ØÞ", "İıſ ǅǆ ȺƄ", "a\u00adb_^`~§¶·¸")


class PairMerger:
    """Merge ranks of one vocabulary file."""

    BITS = 20  # of a symbol's number and of a position in the heap's entries

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-pair merging is supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.number = {s: k for k, s in enumerate(model["vocab"])}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(self.number[left] << self.BITS | self.number[right], (rank, self.number[left + right]))
        whole_alphabet = [chr(b) for b in _SELF] + [chr(c) for c in BYTE_LEVEL.values()]
        if any(c + end not in self.number for c in whole_alphabet for end in {"", self.suffix}):
            raise ValueError(f"{path}: a byte has no symbol, and unknown symbols are not supported")
        self.special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre = whole.normalizer, whole.pre_tokenizer
        # the rules that LATIN_WORDS has in short
        self.latin = False
        self.latin = all(self._slow_pieces(x) == self._latin_pieces(x) for x in LATIN_PROBES)
        self.splits_on_space = self._pieces("ab \n cd") == self._pieces("ab") + self._pieces("cd")
        self.known: dict[str, int] = {}

    def _pieces(self, text: str) -> list[str]:
        if self.latin and (not text or max(text) < "\u0250"):
            # these letters have no combining marks and lower-case one by one, in every Unicode version
            return self._latin_pieces(text)
        return self._slow_pieces(text)

    @staticmethod
    def _latin_pieces(text: str) -> list[str]:
        low = text.lower()
        if low.isascii() and low.isprintable():
            return LATIN_WORDS.findall(low)
        return [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_LEVEL) for p in LATIN_WORDS.findall(low)]

    def _slow_pieces(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [p for p, _ in self.pre.pre_tokenize_str(text) if p]

    def word(self, piece: str) -> int:
        """Symbols left after all merges of one pre-token."""
        number, pairs, bits = self.number, self.pairs, self.BITS
        units = [*piece[:-1], piece[-1] + self.suffix]
        symbols = [number[u] for u in units if u in number]
        n = left = len(symbols)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = max(bits, n.bit_length())
        at, mask = pairs.get, (1 << width) - 1
        heap = [p[0] << width | i for i in range(n - 1) if (p := at(symbols[i] << bits | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & mask
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            pair = at(symbols[i] << bits | symbols[j])
            if pair is None or pair[0] != entry >> width:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair[1], -1
            left -= 1
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if p := at(symbols[i] << bits | symbols[k]):
                    heapq.heappush(heap, p[0] << width | i)
            h = before[i]
            if h >= 0 and (p := at(symbols[h] << bits | symbols[i])):
                heapq.heappush(heap, p[0] << width | h)
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.known
        for piece in self._pieces(text):
            n = known.get(piece)
            if n is None:
                n = self.word(piece)
                if len(piece) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def chunk(self, text: str) -> int:
        """Tokens of any text; each special string inside is one token, as the library has it."""
        for s in self.special:
            if s in text:
                return sum(self.chunk(x) for x in text.split(s)) + text.count(s)
        return self.plain(text) if text else 0


class ChunkCounts(dict):
    """Counts by chunk between white space, kept up to a number of entries."""

    def __init__(self, merger: PairMerger, limit: int = CACHE_WORDS):
        super().__init__()
        self.merger, self.limit = merger, limit

    def __missing__(self, chunk: str) -> int:
        n = self.merger.chunk(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = n
        return n

    def text(self, text: str) -> int:
        """White space ends a word in this vocabulary's rules, so chunks count on their own."""
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        return sum(map(self.__getitem__, text.split(" ")))


@functools.lru_cache(maxsize=2)
def chunk_counts(vocabulary: str) -> ChunkCounts:
    """One table a worker process, kept from task to task."""
    return ChunkCounts(PairMerger(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row of ``docs``.

    ``vocabulary`` is a tokenizers file that every worker can read. Texts count
    whole, without truncation, begin or end tokens; null text is empty and
    counts 0. Special strings inside a text are one token each. The three names
    are replaced where the input has them.
    """

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = chunk_counts(vocabulary)
        one = table.text if table.merger.splits_on_space else table.merger.chunk
        for texts in batches:
            yield pd.Series([0 if t is None else one(t) for t in texts], dtype="int64")

    udf = F.pandas_udf(counts, "long")
    new = ("n_bytes", "n_tokens", "over_limit")
    return docs.select(*(f"`{c}`" for c in docs.columns if c not in new), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), udf(F.col(text_col)).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
