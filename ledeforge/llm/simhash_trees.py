"""SimHash near duplicates by Burkhard-Keller trees.

A text's fingerprint has a bit where more than half of its shingles' hashes have
it. Equal fingerprints are one class before anything is compared. Classes are
filed in shards, and each shard has a tree whose children are keyed by their
integer Hamming distance to the parent; by the triangle inequality a look-up
follows only edges within the radius of its own distance to the node.

Two fingerprints within r bits agree on one of r + 1 parts of their bits. So each
class is filed r + 1 times, in the shard that the hash of one part deals it to,
and looks up its own shards only; the number of shards follows the number of
classes. A part's shard that is still too large is dealt anew by that part and
each of r + 1 parts of the remaining bits, again without losing a pair; after
``DEEPEST`` levels so few bits are free that a shard's size is bounded by them.

Trees stay where their shard is looked up: broadcasting them would send every
fingerprint through the driver. A task joins what it links and passes on one edge
a class at most, so no group of copies is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.grouped import group_arrays
from ledeforge.operators.graph import connected_components
from ledeforge.runtime import bounded_broadcast, input_partitions, materialize, release

BITS = 64
RADIUS = 2
WIDTH = 3
HASH_SEED = 42
#: Classes that a shard is meant to hold, and from which it is dealt anew.
SHARD, LARGEST = 1024, 8192
DEEPEST = 3
#: Shingles whose bits are counted at once, and classes that look up a tree at once.
CHUNK, ASKED = 1 << 13, 256


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit number: bit k is set where over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts, width = np.concatenate([[0], ends[:-1]]), min(width, n)
    count, total = n - width + 1, np.zeros(BITS, dtype=np.int64)
    lo, hi = starts[:count], ends[width - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, CHUNK):
        h = np.fromiter((digest(joined[x:y], HASH_SEED) for x, y in zip(lo[at : at + CHUNK].tolist(), hi[at : at + CHUNK].tolist(), strict=True)), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(``id_col``, fp) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column("text").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], names=[id_col, "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(hashed, f"`{id_col}` {kind}, fp long")


class Tree:
    """A Burkhard-Keller tree as arrays: node k holds ``items[k]``, and its children stand together, by their distance to it.

    ``links`` has 65 * parent + distance of every child, sorted; ``child`` the
    node that each leads to. Items are inserted in order, all of a level at once.
    """

    def __init__(self, items: np.ndarray):
        self.items = items
        left, at = np.arange(1, len(items)), np.zeros(max(0, len(items) - 1), dtype=np.int64)
        links, child = [], []
        while len(left):
            key = at * (BITS + 1) + np.bitwise_count(items[left] ^ items[at])
            edges, first, edge = np.unique(key, return_index=True, return_inverse=True)
            links.append(edges)
            child.append(left[first])
            lower = np.ones(len(left), dtype=bool)
            lower[first] = False
            left, at = left[lower], left[first][edge[lower]]
        self.links = np.concatenate(links) if links else np.zeros(0, np.int64)
        self.child = np.concatenate(child) if child else np.zeros(0, np.int64)
        order = np.argsort(self.links)
        self.links, self.child = self.links[order], self.child[order]

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, node) of all pairs within ``radius``; all look-ups go down the tree together."""
        row, node = np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64)
        rows, nodes = [], []
        while len(row):
            d = np.bitwise_count(asked[row] ^ self.items[node]).astype(np.int64)
            near = d <= radius
            rows.append(row[near])
            nodes.append(node[near])
            lo = np.searchsorted(self.links, node * (BITS + 1) + np.maximum(d - radius, 0))
            many = np.searchsorted(self.links, node * (BITS + 1) + np.minimum(d + radius, BITS), "right") - lo
            start = np.cumsum(many) - many
            node = self.child[np.arange(int(many.sum())) - np.repeat(start - lo, many)]
            row = np.repeat(row, many)
        return np.concatenate(rows), np.concatenate(nodes)


def joined(items: np.ndarray, radius: int) -> np.ndarray:
    """For each item the first one that links within ``radius`` reach, by the tree of them all."""
    tree, root = Tree(items), np.arange(len(items))
    for at in range(0, len(items), ASKED):
        row, node = tree.within(items[at : at + ASKED], radius)
        a, b = row + at, node
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                break
            a, b = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]]), axis=1)
            # each root above another hangs on the least it meets; the rest meet again by their new roots
            np.minimum.at(root, b, a)
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def part_masks(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` cut into so many parts."""
    return [x.tolist() for x in np.array_split(np.array(bits, dtype=np.int64), parts)]


def shard_masks(level: int, radius: int) -> list[tuple[str, int]]:
    """(name, mask) of every way to choose a part at each of ``level`` levels; ``mask`` has the bits that two members agree on."""
    out = []
    for picks in product(range(radius + 1), repeat=level):
        free, mask = list(range(BITS)), 0
        for k in picks:
            part = part_masks(free, radius + 1)[k]
            mask |= sum(1 << b for b in part)
            free = [b for b in free if b not in part]
        out.append(("".join(map(str, picks)), mask))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _filed(classes: DataFrame, level: int, radius: int, shards: int) -> DataFrame:
    """(part, shard, fp): the shards of each class on a level; ``classes`` has the part that it was filed by on the level above, or ''."""
    ways = F.array(*(F.struct(F.lit(n).alias("part"), F.lit(_signed(m)).alias("mask")) for n, m in shard_masks(level, radius)))
    mine = F.filter(ways, lambda w: w["part"].startswith(F.col("above")))
    rows = classes.select("fp", F.explode(mine).alias("w"))
    return rows.select(F.col("w.part").alias("part"), F.pmod(F.xxhash64("w.part", F.col("fp").bitwiseAND(F.col("w.mask"))), F.lit(shards)).alias("shard"), "fp")


def _linked(filed: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that join what each shard links."""

    def edges(batches) -> Iterator:
        import pandas as pd

        frames = (b.to_pandas() for b in batches)
        for g in group_arrays(frames, ["part", "shard"], ["fp"]):
            items = g["fp"].astype(np.int64)
            root = joined(items.view(np.uint64), radius)
            to = np.flatnonzero(root != np.arange(len(items)))
            if len(to):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"a": items[root[to]], "b": items[to]}), preserve_index=False)

    dealt = filed.repartition(input_partitions(filed.sparkSession), "part", "shard").sortWithinPartitions("part", "shard")
    return dealt.mapInArrow(edges, "a long, b long")


def near_fingerprints(classes: DataFrame, radius: int = RADIUS, shard: int = SHARD, largest: int = LARGEST) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits."""
    n = classes.count()
    edges, todo = [], classes.select("fp", F.lit("").alias("above"))
    for level in range(1, DEEPEST + 1):
        # deeper levels are for what shares more bits, which hashes of more shards keep apart
        shards = max(1, -(-n // shard)) if level == 1 else 1 << 62
        filed = materialize(_filed(todo, level, radius, shards), "simhash-filed")
        sizes = filed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("g"))
        large = materialize(sizes.filter(F.col("g") > (largest if level < DEEPEST else 1 << 62)).select("part", "shard"), "simhash-large")
        if large.isEmpty():
            edges.append(materialize(_linked(filed, radius), "simhash-edges"))
            release(filed, large)
            break
        few = bounded_broadcast(large)
        edges.append(materialize(_linked(filed.join(few, ["part", "shard"], "left_anti"), radius), "simhash-edges"))
        todo = materialize(filed.join(few, ["part", "shard"], "left_semi").select("fp", F.col("part").alias("above")).distinct(), "simhash-dense")
        release(filed, large)
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, shard: int = SHARD, largest: int = LARGEST) -> DataFrame:
    """(``id_col``, fingerprint, component_id) of every row.

    Words are parted by white space, with A-Z lower-cased; a text with fewer than
    ``width`` words is one shingle, and null, empty and blank texts have fingerprint
    zero, which links like any other. A component is the smallest id that links of
    ``radius`` bits or fewer reach. A row that repeats an id links by its own text,
    not by the id. A row with a null id has a fingerprint and a null component, and
    links nothing. An empty table gives no rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    classes = materialize(prints.filter(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    edges = near_fingerprints(classes, radius, shard, largest)
    named = classes.join(connected_components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "simhash-named")
    # a component of very many classes is one row a task before it moves; its classes are joined with that row by a split join
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("component", F.col("component_id").alias("least_of_all"))
    found = materialize(named.join(materialize(least, "simhash-least"), "component", "left").select("fp", F.coalesce("least_of_all", "least").alias("component_id")), "simhash-found")
    hexed: Column = F.lpad(F.lower(F.hex("fp")), 16, "0")
    out = prints.join(found, "fp", "left")
    return out.select(id_col, hexed.alias("fingerprint"), F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
