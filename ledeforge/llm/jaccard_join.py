"""Size-aware heavy-light similarity join of word shingle sets.

Small sets enumerate their subsets of the sizes that a link needs, so sharing
one subset is (nearly) the link itself. Large sets file the rarest tokens of
their prefix in inverted lists, whose meetings are candidates. A cost model on a
bounded sample (subsets emitted against list entries scanned) sets the boundary
between them; sets just below it are filed both ways. Prefixes are ordered by
rarity as the sample lets it be estimated: by the frequencies of a shingle's
words, with shingles that the sample itself repeats last. Boundary and order
only move cost: any choice gives the same links.

Equal sets are one class before anything is joined; the row of one member, by
its number, stands for the class throughout, so ids may repeat. Candidates go
through parity bitmaps, whose Hamming distance bounds the symmetric difference
from below, so no pair within reach is lost; sets are built only for what passes
and compared exactly. A linked pair meets at the first token that its prefixes
share, so what follows that token on either side bounds the overlap, and a
meeting with too little left on a side is passed over. Short lists give all their
pairs. In long ones, members are first compared with one of them alone; those that
remain in different components are then scanned in blocks of bounded size, and
only edges that would unite two components go on. A refuted edge may have hidden
others, so the rows that refuted edges hang together with are scanned once more,
with their sets: there a pair is compared exactly before it unites anything, so
nothing is hidden and only links of a forest are passed on. Pairs of a family are
thus compared where its rows meet, but never emitted as such.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.grouped import group_arrays
from ledeforge.llm.shingles import WIDTH, mixed, shingle_set, windows, word_hashes
from ledeforge.llm.workers import tidy
from ledeforge.operators.graph import connected_components
from ledeforge.runtime import bounded_broadcast, input_partitions, materialize, release, settle

#: Documents that the sample takes, about, by hash of their id, and the sample's frequency from which a token counts as frequent.
SAMPLE_DOCS = 2_000
FREQUENT = 4
LARGEST_SMALL = 10
BITS = 2048
BLOCK = 2048
#: Lists of so many members or fewer give all their pairs.
SHORT_LIST = 16
#: Rows of a batch while sets are built, since a row holds its text, keys and bitmap at once.
SET_ROWS = 500
#: Pairs of a batch while sets are compared, and shingles of the rows that a block holds with their sets.
PAIR_ROWS, BLOCK_SHINGLES = 200, 1 << 20


def overlap(n, m, percent: int):
    """Least intersection of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """Tokens of which a linked set must have at least one."""
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of n shares with a linked set of any size."""
    return sorted({overlap(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1)})


def choose_boundary(sizes: Counter, lengths: dict[int, float], percent: int) -> int:
    """The size up to which sets enumerate subsets, with the least cost of the sample; ``lengths``: mean list length by size."""

    def cost(b: int) -> float:
        light = sum(c * sum(comb(n, k) for k in subset_sizes(n, percent)) for n, c in sizes.items() if 0 < n <= b)
        return light + sum(c * prefix(n, percent) * (1 + lengths.get(n, 0.0)) for n, c in sizes.items() if 100 * n > percent * b)

    return min(range(LARGEST_SMALL + 1), key=lambda b: (cost(b), b))


class Rarity:
    """A total order of shingles from a bounded sample: by word frequency, then by hash; frequent shingles come last."""

    def __init__(self, words: dict[int, int], frequent: np.ndarray):
        self.words, self.frequent = words, frequent
        order = np.argsort(np.array(list(words), dtype=np.uint64)) if words else np.zeros(0, np.int64)
        self.hashes = np.array(list(words), dtype=np.uint64)[order]
        # sixteenths of a bit, so sums are exact
        self.bits = np.rint(16 * np.log2(np.array(list(words.values()), dtype=np.float64) + 1)).astype(np.int64)[order] if words else np.zeros(0, np.int64)

    def ordered_set(self, text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingles sorted by hash, the same from rare to frequent)."""
        h = word_hashes(text)
        if not len(h):
            return h, h
        width = min(width, len(h))
        s, first = np.unique(windows(h, width), return_index=True)
        score = np.zeros(len(h), dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            score = np.where(self.hashes[at] == h, self.bits[at], 0)
        total = np.concatenate([[0], np.cumsum(score)])
        cost = (total[width:] - total[:-width])[first]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
            cost = cost + np.where(self.frequent[at] == s, 1 << 40, 0)
        return s, s[np.argsort(cost, kind="stable")]


def keys_of(s: np.ndarray, ordered: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Subset and list keys of one set."""
    n, keys = len(s), []
    if n <= boundary:
        for size in subset_sizes(n, percent):
            keys += [xxhash.xxh3_64_intdigest(np.array(c, dtype=np.uint64).tobytes(), size) for c in combinations(s.tolist(), size)]
    if 100 * n > percent * boundary:
        keys += mixed(ordered[: prefix(n, percent)] + np.uint64(0xA5A5)).tolist()
    return np.array(keys, dtype=np.uint64)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the set's members by position; two bitmaps differ in no more places than their sets do.

    The number of positions grows with the set, or large sets would fill it; it
    is a power of two, so that halves can be folded onto each other.
    """
    size = max(BITS, 1 << (4 * max(1, len(s)) - 1).bit_length())
    at = ((s >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Rows of ``size`` bytes as words; larger maps fold, which keeps parities."""
    out = []
    for m in maps:
        x = np.frombuffer(m, np.uint64)
        while x.nbytes > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out)


def _sample(docs: DataFrame, percent: int, width: int) -> tuple[Rarity, int]:
    total = docs.count()
    rows = docs
    if total > SAMPLE_DOCS:
        rows = docs.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * SAMPLE_DOCS / total))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [word_hashes(t) for t in b["text"]]
            yield pd.DataFrame({"h": [h.tobytes() for h in hashes]})

    # about SAMPLE_DOCS documents; the driver keeps words and shingles that they repeat
    words = [np.frombuffer(h, np.uint64) for h in rows.select("text").mapInPandas(sets, "h binary").toPandas()["h"]]
    words = [h for h in words if len(h)]
    if not words:
        return Rarity({}, np.zeros(0, np.uint64)), 0
    seen, often = np.unique(np.concatenate(words), return_counts=True)
    found = [np.unique(windows(h, min(width, len(h)))) for h in words]
    tokens, times = np.unique(np.concatenate(found), return_counts=True)
    lengths: dict[int, list[float]] = {}
    for s in found:
        if len(s) <= 2 * LARGEST_SMALL:
            t = times[np.searchsorted(tokens, s)]
            lengths.setdefault(len(s), []).append(float((np.sort(t)[: prefix(len(s), percent)] - 1).mean()) * total / len(found))
    known = often > 1
    rarity = Rarity(dict(zip(seen[known].tolist(), often[known].tolist(), strict=True)), tokens[times >= FREQUENT])
    return rarity, choose_boundary(Counter(len(s) for s in found), {n: float(np.mean(v)) for n, v in lengths.items()}, percent)


def _within(n: np.ndarray, m: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n + m - both)


def _in_reach(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps can't rule out."""
    side = lambda x: maps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    whole = pairs.join(side("b"), "b").join(side("a"), "a")
    whole = whole.filter(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for size, g in f.groupby(np.minimum(f["bitsa"].str.len(), f["bitsb"].str.len()).to_numpy()):
                x, y = folded(g["bitsa"].tolist(), size), folded(g["bitsb"].tolist(), size)
                n, m = g["na"].to_numpy(np.int64), g["nb"].to_numpy(np.int64)
                yield g.loc[np.bitwise_count(x ^ y).sum(axis=1) <= n + m - 2 * overlap(n, m, percent), ["a", "b"]]

    return whole.mapInPandas(tidy(compare), "a long, b long")


def _sets_of(nodes: DataFrame, named: DataFrame, src: DataFrame, width: int) -> DataFrame:
    """(node, s): the materialised sets of ``nodes`` (node); ``named`` has the id and the text's hash of every node's row."""
    wanted = materialize(named.join(bounded_broadcast(nodes), "node", "left_semi").select("node", "id", "digest"), "jaccard-wanted")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "s": [shingle_set(t, width).tobytes() for t in b["text"]]})

    # rows alike in id and text are one
    rows = src.join(wanted, ["id", "digest"]).select("node", "text").dropDuplicates(["node"])
    sets = materialize(rows.mapInPandas(tidy(texts), "node long, s binary"), "jaccard-sets", SET_ROWS)
    release(wanted)
    return sets


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    return bool(_within(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))


def _verified(pairs: DataFrame, named: DataFrame, src: DataFrame, percent: int, width: int) -> DataFrame:
    """The materialised pairs (a, b) whose sets link, by exact comparison; sets are built for them alone."""
    nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-ids")
    sets = _sets_of(nodes, named, src, width)
    whole = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ok = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(frame["sa"], frame["sb"], strict=True)]
            yield frame.loc[np.array(ok, dtype=bool), ["a", "b"]]

    links = materialize(whole.mapInPandas(tidy(compare), "a long, b long"), "jaccard-links", PAIR_ROWS)
    settle(src.sparkSession)
    release(nodes, sets)
    return links


def _enough_left(a: str, b: str, percent: int) -> Column:
    """Whether two sizes, and what is left of each set from the shared key on, allow a link."""
    sizes = F.col(f"n{a}") + F.col(f"n{b}")
    near = F.lit(100) * F.least(f"n{a}", f"n{b}") >= F.lit(percent) * F.greatest(f"n{a}", f"n{b}")
    return near & (F.lit(100 + percent) * F.least(f"rest{a}", f"rest{b}") >= F.lit(percent) * sizes)


def _doubtful(tried: DataFrame, links: DataFrame, comps: DataFrame) -> DataFrame:
    """Nodes that refuted pairs hang together with: only among them may a pair have been taken for united wrongly."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    refuted = tried.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    hung = connected_components(links.union(tried))
    # the smallest of a component has no row there, and may be an end of what was refuted
    taken = hung.unionByName(hung.select(F.col("component").alias("node"), "component").distinct())
    wrong = taken.join(refuted.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    return materialize(taken.join(wrong, "component", "left_semi").select("node"), "jaccard-doubtful")


def _lists_once(rows: DataFrame, blocks: Column) -> DataFrame:
    """(key, node, component, rest, nb) of the lists of ``rows`` with several components, those of the very same nodes as one.

    A common line or passage makes many such lists. Of a node's ``rest``, the largest stays, so no meeting is passed over that one of them allows.
    """
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"s{seed}") for seed in (1, 2)]
    lists = rows.groupBy("key").agg(blocks.alias("b"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("g"), *same)
    lists = materialize(lists.filter(F.col("lo") < F.col("hi")).select("key", "g", "s1", "s2", F.ceil("b").cast("int").alias("nb")), "jaccard-split")
    names = lists.groupBy("g", "s1", "s2").agg(F.min("key").alias("name"))
    # the block count goes by the nodes, so lists of the same ones agree on it
    named = lists.join(names, ["g", "s1", "s2"]).select("key", "name", "nb")
    return rows.join(named, "key").groupBy(F.col("name").alias("key"), "node", "component", "nb").agg(F.max("rest").alias("rest"))


def _apart(shared: DataFrame, maps: DataFrame, comps: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """Pairs in lists that are in different components and within reach by size and bitmap, as far as they unite components in a task.

    With ``sets`` (node, s), a pair is compared exactly first, so that all pairs given are links and none is hidden by a wrong one.
    """
    rows = shared.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # what a block holds: rows, or as many as their sets' sizes allow
    if sets is not None:
        rows = rows.join(maps.select("node", "n"), "node")
    blocks = F.count(F.lit(1)) / BLOCK if sets is None else F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    rows = _lists_once(rows, blocks)
    mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    cols = ["node", "component", "n", "rest", "bits", *(["s"] if sets is not None else [])]
    rows = rows.select("key", "node", "component", "rest", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    # bitmaps and sets come last, so that they are dealt once
    rows = rows.join(maps if sets is None else maps.join(sets, "node"), "node").select("key", *cols, "mine", "other")
    rows = rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")
    exact = sets is not None

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        out: list[tuple] = []
        for g in group_arrays(batches, ["key", "i", "j"], [*cols, "mine", "i", "j"]):
            comp = np.array([root(c) for c in g["component"].tolist()])
            if (comp == comp[0]).all():
                continue
            order = np.argsort(g["n"], kind="stable")
            nodes, comp, n, mine = g["node"][order], comp[order], g["n"][order].astype(np.int64), g["mine"][order]
            rest = g["rest"][order].astype(np.int64)
            across = g["i"][0] != g["j"][0]
            bits = g["bits"][order]
            sets_ = [np.frombuffer(s, np.uint64) for s in g["s"][order]] if exact else None
            size = np.array([len(b) for b in bits])  # grows with n
            level, known, low = 0, np.zeros((0, 0), np.uint64), 0
            ends = np.searchsorted(n, 100 * n // percent, side="right")
            for x in range(len(n) - 1):
                at = np.arange(x + 1, ends[x])
                at = at[(comp[at] != comp[x]) & (np.minimum(rest[at], rest[x]) >= overlap(n[at], n[x], percent))]
                if across:
                    at = at[mine[at] != mine[x]]
                if not len(at):
                    continue
                if size[x] != level:  # all that follow are as large or larger
                    level, low = int(size[x]), x
                    known = folded(bits[low : ends[size == level].max()].tolist(), level)
                apart = np.bitwise_count(known[at - low] ^ known[x - low]).sum(axis=1)
                at = at[apart <= n[at] + n[x] - 2 * overlap(n[at], n[x], percent)]
                for y in at.tolist():
                    p, q = root(comp[x].item()), root(comp[y].item())
                    if p == q or (exact and not _alike(sets_[x], sets_[y], percent)):
                        continue
                    parent[max(p, q)] = min(p, q)
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    dealt = rows.repartition(input_partitions(shared.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(tidy(pairs), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = WIDTH) -> DataFrame:
    """(``id_col``, n_shingles, component_id) of every row.

    A row's set has the distinct ``width``-word shingles of its whole text; with
    fewer words, the sequence as one. Rows link when their sets' Jaccard
    similarity is ``percent`` or more in hundredths. A component is the smallest
    id that links reach, its own included. Null, empty and blank texts have no
    shingles and link with nothing. A row that repeats an id links by its own
    text, and the id alone links nothing. A row with a null id has no links and a
    null component.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    rarity, boundary = _sample(src, percent, width)
    shared_rarity = spark.sparkContext.broadcast(rarity)  # what SAMPLE_DOCS documents repeat

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = shared_rarity.value
        for b in batches:
            out = []
            for t in b["text"]:
                s, ordered = order.ordered_set(t, width)
                sign = xxhash.xxh3_128_intdigest(s.tobytes())
                lo, hi = (sign & (2**64 - 1)) - 2**63, (sign >> 64) - 2**63
                keys = keys_of(s, ordered, boundary, percent).view(np.int64) if len(s) else np.zeros(0, np.int64)
                out.append((len(s), lo, hi, keys, bitmap(s)))
            frame = pd.DataFrame(out, columns=["n", "lo", "hi", "keys", "bits"])
            frame.insert(0, "digest", b["digest"].to_numpy())
            frame.insert(0, "id", b["id"].to_numpy())
            yield frame

    made = src.mapInPandas(tidy(keyed), "id long, digest long, n long, lo long, hi long, keys array<long>, bits binary")
    sets = materialize(made.withColumn("node", F.monotonically_increasing_id()), "jaccard-keys", SET_ROWS)
    first = F.min(F.struct("id", "node"))  # the node that stands for a class
    classes = sets.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("lo", "hi").agg(first.alias("f"))
    classes = materialize(classes.select("lo", "hi", F.col("f.id").alias("least"), F.col("f.node").alias("node")), "jaccard-classes")
    leaders = sets.join(classes.select("node"), "node", "left_semi")
    named = leaders.select("node", "id", "digest")
    # what is left of a set from a list key on; subset keys come first and leave all of it
    in_lists = F.when(F.lit(100) * F.col("n") > percent * boundary, F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1).otherwise(0)
    lists_at = F.size("keys") - in_lists
    packed = F.shiftleft("n", 32) + F.col("n") - F.greatest(F.col("at") - F.col("lists_at"), F.lit(0))  # one number for two
    filed = leaders.select("node", "n", lists_at.alias("lists_at"), F.posexplode("keys").alias("at", "key")).select("node", "key", packed.alias("packed"))
    lists = filed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("g")).filter(F.col("g") > 1)
    met = materialize(filed.join(lists, "key").select("key", "node", "pivot", "g", F.shiftright("packed", 32).alias("n"), F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)).alias("rest")), "jaccard-lists")
    settle(spark)
    maps = leaders.select("node", "n", "bits")
    side = lambda rows, x: rows.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("rest").alias(f"rest{x}"))
    short, long_lists = met.filter(F.col("g") <= SHORT_LIST), met.filter(F.col("g") > SHORT_LIST)
    met_pairs = side(short, "a").join(side(short, "b"), "key").filter((F.col("a") < F.col("b")) & _enough_left("a", "b", percent)).select("a", "b")
    stars = side(long_lists.filter(F.col("node") == F.col("pivot")), "a").join(side(long_lists.filter(F.col("node") != F.col("pivot")), "b"), "key").filter(_enough_left("a", "b", percent)).select("a", "b")
    reached = materialize(_in_reach(met_pairs.union(stars).distinct(), maps, percent), "jaccard-pairs")
    settle(spark)
    links = _verified(reached, named, src, percent, width)
    release(reached)
    comps = connected_components(links)
    shared = long_lists.select("key", "node", "rest")
    if not shared.isEmpty():
        tried = materialize(_apart(shared, maps, comps, percent), "jaccard-tried")
        settle(spark)
        found = _verified(tried, named, src, percent, width)
        n_found, n_tried = found.count(), tried.count()
        if n_found:
            links = links.union(found)
            comps = connected_components(links)
        if n_found < n_tried:
            doubted = _doubtful(tried, links, comps)
            few = bounded_broadcast(doubted)
            again = materialize(shared.join(few, "node", "left_semi"), "jaccard-doubted")
            sets_ = _sets_of(doubted, named, src, width)
            links = links.union(materialize(_apart(again, maps.join(few, "node", "left_semi"), comps, percent, sets_), "jaccard-links"))
            comps = connected_components(links)
            release(again, doubted, sets_)
        release(tried)
    release(met)
    settle(spark)
    # a component's name is its smallest id, of whichever class
    whole = materialize(classes.join(comps, "node", "left").select("lo", "hi", "least", F.coalesce("component", "node").alias("component")), "jaccard-whole")
    joint = whole.groupBy("component").agg(F.min("least").alias("all_least"), F.count(F.lit(1)).alias("g")).filter(F.col("g") > 1).select("component", "all_least")
    of_class = materialize(whole.join(joint, "component", "left").select("lo", "hi", F.coalesce("all_least", "least").alias("component")), "jaccard-named")
    release(whole, classes)
    out = sets.select("id", "n", "lo", "hi").join(of_class, ["lo", "hi"], "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))
