"""Benchmark decontamination with SimHash windows and Hamming blocks.

A document window has the size of a benchmark item. Windows worth a fingerprint
start at a shingle of their item and hold enough of its shingles: sliding any
window right to its first such shingle never lowers its similarity, so nothing
in reach is passed over. Window and item fingerprints are cut into one block
more than the radius, so any two within the radius agree in a block; the blocks
are an index, filed by item since a window knows the item it was cut for, and
linear in the windows. Candidates within the radius are then compared exactly,
as bags of shingles. Texts are never shuffled but beyond a counted bound of hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.text import ascii_lower, words
from ledeforge.runtime import bounded_broadcast, materialize, release

WIDTH = 5
PERCENT = 80
#: At similarity 0.8 a bit differs with probability 0.15; 22 of 64 lie over four deviations beyond the mean.
RADIUS = 22
#: The benchmark's side of a join is broadcast up to so many shingles.
BROADCAST_ROWS = 1_000_000

_SIMHASH = (
    "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(CASE WHEN 2 * aggregate({g}, 0L, (c, x) -> c + (shiftright(x, b) & 1L)) > size({g}) THEN 1L ELSE 0L END, b))"
)


def _grams(w: str, width: int) -> Column:
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def _of_width(w: str, widths: list[int]) -> Column:
    """Shingles of the column ``width`` words wide."""
    out = F.array().cast("array<bigint>")
    for k in widths:
        out = F.when(F.col("width") == k, _grams(w, k)).otherwise(out)
    return out


def simhash(grams: str) -> Column:
    """64 bits, each the majority of that bit over a bag of hashes."""
    return F.expr(_SIMHASH.format(g=grams))


def _bag(grams: str) -> Column:
    """A bag as a set: each hash with the number of its earlier occurrences."""
    return F.transform(grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g))))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint's bits, cut into ``radius + 1`` pieces."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)))


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    w = benchmark.select(F.col(item_id).alias("item"), words(ascii_lower(F.coalesce(F.col(item_text), F.lit("")))).alias("iw"))
    w = w.filter((F.size("iw") > 0) & F.col("item").isNotNull()).select("item", "iw", F.size("iw").alias("m"), F.least(F.size("iw"), F.lit(WIDTH)).alias("width"))
    g = w.select("item", "m", "width", _of_width("iw", list(range(1, WIDTH + 1))).alias("ig"))
    return g.select("item", "m", "width", "ig", simhash("ig").alias("ifp"), _bag("ig").alias("ibag"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(``id_col``, digest, item, start, n_words, similarity): each row's best window for each item it leaks.

    A window leaks an item if 100 times the intersection of their bags of
    ``WIDTH``-word shingles is ``percent`` times the union or more; items with
    fewer words are one shingle. Windows start at a shingle of the item, start
    counts words from 0, and among equals the first window stays. Null, empty and blank texts and items have no windows,
    and items with a null id are left out. Rows that repeat an id and text have one result.
    ``digest`` is a hash of the text, which tells rows that repeat an id apart.
    """
    items = materialize(_items(benchmark, item_id, item_text), "leak-items")
    size = items.agg(F.coalesce(F.sum(F.size("ig")), F.lit(0)).alias("n"), F.collect_set("width").alias("w")).first()
    widths = sorted(size["w"])
    small = F.broadcast if size["n"] <= BROADCAST_ROWS else (lambda x: x)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("digest"), words(ascii_lower(text)).alias("w"))
    if not widths:
        return src.limit(0).select(F.col("doc").alias(id_col), "digest", F.lit(None).cast(dict(benchmark.dtypes)[item_id]).alias("item"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    index = small(items.select("item", "m", "width", F.size("ig").alias("k"), F.explode(F.array_distinct("ig")).alias("gram")))
    hits = None
    for k in widths:
        met = src.select("doc", "digest", F.posexplode(_grams("w", k)).alias("pos", "gram")).join(index.filter(F.col("width") == k), "gram")
        hits = met if hits is None else hits.union(met)
    at = hits.groupBy("doc", "digest", "item", "m", "width", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    need = F.ceil(F.lit(percent) * F.col("k") / 100).cast("int")
    starts = at.withColumn("need", need).withColumn("starts", F.filter("at", lambda p, i: F.get("at", i + F.col("need") - 1) - p < F.col("k")))
    # documents with hits only; their text is read again instead of carried along, and each window keeps the item that it is a window of
    windows = materialize(starts.filter(F.size("starts") > 0).select(F.col("doc").alias("d"), F.col("digest").alias("dg"), "item", "m", "width", F.explode("starts").alias("start")), "leak-windows")
    texts = src.join(bounded_broadcast(windows), F.col("doc").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("dg")))
    cut = texts.select("doc", "digest", "item", "m", "width", "start", F.slice("w", F.col("start") + 1, F.col("m")).alias("win"))
    cut = cut.select("doc", "digest", "item", "start", F.size("win").alias("n_words"), _of_width("win", widths).alias("g"))
    cut = materialize(cut.withColumns({"k1": F.xxhash64("g"), "k2": F.xxhash64(F.lit(7), "g")}), "leak-cut")
    # equal windows of many documents are judged once an item; each step is written, or its functions would move into the join's condition
    kinds = materialize(cut.select("item", "k1", "k2", "g").dropDuplicates(["item", "k1", "k2"]).withColumn("fp", simhash("g")), "leak-kinds")
    marked = kinds.select("item", "k1", "k2", "fp", F.posexplode(_blocks(F.col("fp"), radius)).alias("block", "bits"))
    filed = small(items.select("item", "ifp", F.posexplode(_blocks(F.col("ifp"), radius)).alias("block", "bits")))
    x = F.col("fp").bitwiseXOR(F.col("ifp"))
    # the index is filed by item as well, so a window meets its own item's blocks alone
    near = materialize(marked.join(filed, ["item", "block", "bits"]).filter(F.bit_count(x) <= radius).select("item", "k1", "k2").distinct(), "leak-near")
    bags = near.join(kinds.select("item", "k1", "k2", _bag("g").alias("bag")), ["item", "k1", "k2"]).join(small(items.select("item", "ibag")), "item")
    sized = bags.select("item", "k1", "k2", F.size(F.array_intersect("bag", "ibag")).alias("inter"), (F.size("bag") + F.size("ibag")).alias("both"))
    sizes = materialize(sized, "leak-sizes")
    leaks = sizes.filter(F.lit(100) * F.col("inter") >= F.lit(percent) * (F.col("both") - F.col("inter")))
    found = cut.select("doc", "digest", "item", "start", "n_words", "k1", "k2").join(leaks, ["item", "k1", "k2"])
    best = found.groupBy("doc", "digest", "item").agg(F.max(F.struct((F.col("inter") / (F.col("both") - F.col("inter"))).alias("similarity"), (-F.col("start")).alias("back"), "n_words")).alias("best"))
    out = materialize(best.select(F.col("doc").alias(id_col), "digest", "item", (-F.col("best.back")).alias("start"), "best.n_words", "best.similarity"), "leaks")
    release(items, windows, cut, kinds, near, sizes)
    return out


def decontaminate(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any leak; null ids and texts are handled like others. ``leaks`` as ``find_leaks`` returns them.

    Ids of leaking rows are broadcast up to a counted bound, so that texts stay where they are.
    """
    bad = materialize(leaks.select(F.col(id_col).alias("_doc"), F.col("digest").alias("_digest")).distinct(), "leak-ids")
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bounded_broadcast(bad), F.col(id_col).eqNullSafe(F.col("_doc")) & (digest == F.col("_digest")), "left_anti")
