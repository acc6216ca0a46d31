"""Prefix trie of conversations, with totals by leaf peeling.

A node is a distinct sequence of first turns, found by aggregation on a hash of
the prefix: the running XOR of hashes that each turn and its place have, which
needs no order of evaluation and can be summed in parts.

Totals travel upward as messages. Nodes keep a counter of children that have not
reported; those at zero send their subtree's totals to the parent, round by round,
until the root has heard from all. What peels in one step is a whole path: each
node hands its path on to the child that holds its member of the highest hash. A
walk to the root changes paths only where that member changes, about ln(members)
times, so the rounds follow the logarithm of the conversations and not the turns
of the longest. Within a path, totals are running sums from its lower end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.runtime import input_partitions, materialize, release

#: Rows of a key that one task numbers or sums at a time; longer ones are cut into parts of this many.
PART = 4096
#: Conversations that share a base, and the most turns (less one) taken from it: fixed values of the query.
FAMILY, HEADS = 5, 9


def _numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, from 1, within ``key`` by ``order``. Rows are dealt by ranges, so a key of very many rows is numbered by many tasks."""
    dealt = materialize(rows.repartitionByRange(input_partitions(rows.sparkSession), key, *order).withColumn("_part", F.spark_partition_id()), "trie-turns")
    sizes = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).select(key, "_part", "_before")
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return dealt.withColumn("_local", local).join(before, [key, "_part"]).withColumn("pos", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def _running(rows: DataFrame, key: str, at: str, sums: dict[str, Column], fn, down: bool = False) -> DataFrame:
    """``rows`` with running aggregates ``fn`` of ``sums`` within ``key``, by the dense number ``at``, from its high end with ``down``; in parts of ``PART`` rows, whose totals are carried over."""
    order = F.col(at).desc() if down else F.col(at).asc()
    cut = rows.withColumn("_part", F.floor(F.col(at) / PART))
    total = cut.groupBy(key, "_part").agg(*(fn(c).alias(f"_t{n}") for n, c in sums.items()))
    ahead = Window.partitionBy(key).orderBy(F.col("_part").desc() if down else F.col("_part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(key, "_part", *(fn(F.col(f"_t{n}")).over(ahead).alias(f"_c{n}") for n in sums))
    within = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = cut.select("*", *(fn(c).over(within).alias(f"_r{n}") for n, c in sums.items())).join(carried, [key, "_part"])
    join = (lambda a, b: a.bitwiseXOR(b)) if fn is F.bit_xor else (lambda a, b: a + b)
    return both.withColumns({n: join(F.col(f"_r{n}"), F.coalesce(F.col(f"_c{n}"), F.lit(0))) for n in sums}).drop("_part", *(f"_{k}{n}" for n in sums for k in "rc"))


def conversation_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, bytes): turns numbered from 1, with two hashes of role and text and the text's length. Equal turn numbers go by the hashes."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(7), text, role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return _numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]).drop("turn")


def with_shared_heads(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: conversation c takes its first h turns from c - c % ``family``, h being the CRC-32 of c modulo ``heads``, and goes on with its own turns after the first h.

    Turns have (conv, depth, t1, t2, bytes), conversations (conv, length); one left without turns has length 0.
    """
    sizes = materialize(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    convs = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), h.alias("h"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = materialize(convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-convs")
    own = turns.join(convs.select("conv", "h", "taken"), "conv").filter(F.col("pos") > F.col("h"))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "bytes")
    # fewer than ``heads`` rows of a base meet at most ``family`` conversations
    early = turns.filter((F.col("pos") < heads) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    lent = early.join(convs.select("base", "conv", "h"), "base").filter(F.col("pos") <= F.col("h")).select("conv", F.col("pos").alias("depth"), "t1", "t2", "bytes")
    lengths = convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return own.unionByName(lent), lengths


def _priority(conv: Column) -> Column:
    return F.struct(F.xxhash64(conv).alias("p"), conv.alias("conv"))


def prefix_nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(a, b, depth, up_a, up_b, conv_id, n_convs, path, bytes): a row for each distinct prefix; ``path`` is the member of the highest hash."""
    term = lambda seed: F.xxhash64(F.lit(seed), "depth", "t1", "t2")
    hashed = _running(turns, "conv", "depth", {"a": term(1), "b": term(2)}, F.bit_xor)
    hashed = hashed.withColumns({"up_a": F.col("a").bitwiseXOR(term(1)), "up_b": F.col("b").bitwiseXOR(term(2))})
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.select("conv", zero.alias("depth"), zero.alias("bytes"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"))
    every = hashed.select(*root.columns).unionByName(root)
    by_depth = every.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max(_priority(F.col("conv"))).alias("m"),
        F.min("bytes").alias("bytes"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
    )
    return by_depth.withColumn("path", F.col("m.conv")).drop("m")


def peel(paths: DataFrame) -> DataFrame:
    """(path, up, at, leaves, saved) of every path with the totals of all that hangs on it; ``paths`` has its own ones.

    ``up`` is the path that a path's first node hangs on, ``at`` the depth of the
    node it hangs on there. Each round, the paths whose counter is zero report to
    the paths they hang on; what they hold is final. Every round's reports and
    remaining paths are written, so lineage stays short.
    """
    waiting = paths.groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("remaining"))
    state = materialize(paths.join(waiting.filter(F.col("path").isNotNull()), "path", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0))), "trie-state")
    done: list[DataFrame] = []
    while not state.isEmpty():
        ready = materialize(state.filter(F.col("remaining") == 0).drop("remaining"), "trie-ready")
        done.append(ready)
        told = ready.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        heard = state.filter(F.col("remaining") > 0).join(told, "path", "left")
        add = lambda c, d: F.col(c) + F.coalesce(d, F.lit(0))
        heard = heard.withColumns({"leaves": add("leaves", "_leaves"), "saved": add("saved", "_saved"), "remaining": F.col("remaining") - F.coalesce("_n", F.lit(0))}).select(*state.columns)
        after = materialize(heard, "trie-state")
        release(state)
        state = after
    release(state)
    out = paths.limit(0)
    for f in done:
        out = out.unionByName(f)
    return out


def _ends_hash(ends: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256): SHA-256 of the decimal ids of (a, b, depth, conv), ascending, comma-joined.

    Ids go as lists of up to ``PART``, by ranges of ids, and are hashed as they
    stream by, so memory doesn't follow the ids of a node.
    """
    block = F.floor(F.col("conv") / PART)
    lists = ends.groupBy("depth", "a", "b", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["depth", "a", "b", "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) > 20_000:
                yield flush()
                out = []
        if node is not None:
            out.append((*node, sha.hexdigest()))
        yield flush()

    dealt = lists.repartition(input_partitions(ends.sparkSession), "depth", "a", "b").sortWithinPartitions("depth", "a", "b", "block")
    return dealt.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` has (conv, depth, t1, t2, bytes) with depths from 1 without gaps,
    ``lengths`` (conv, length) of all members, turnless ones included. A node is
    named by its depth and its smallest member; subtrees include their top. Without
    members there are no nodes.
    """
    nodes = materialize(prefix_nodes(turns, lengths), "trie-nodes")
    up = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    children = nodes.filter(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    placed = nodes.join(up, ["depth", "up_a", "up_b"], "left").join(children, ["depth", "a", "b"], "left").drop("up_a", "up_b")
    placed = placed.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = {"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("bytes")}
    placed = materialize(placed.withColumns(own), "trie-placed")
    release(nodes)

    # a path's first node is the one whose parent is on another path, or none
    first = F.col("up").isNull() | (F.col("up") != F.col("path"))
    paths = placed.groupBy("path").agg(F.max(F.when(first, F.col("up"))).alias("up"), (F.min("depth") - 1).alias("at"), F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    paths = materialize(paths, "trie-paths")
    totals = peel(paths)

    # what a node's side paths have reported counts for it and all above it on its path
    reports = totals.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("r_leaves"), F.sum("saved").alias("r_saved"))
    told = placed.join(reports, ["path", "depth"], "left")
    sums = {"n_leaves": F.col("leaf") + F.coalesce("r_leaves", F.lit(0)), "saved_tokens": F.col("saving") + F.coalesce("r_saved", F.lit(0))}
    summed = _running(told, "path", "depth", sums, F.sum, down=True)

    ends = _ends_of(turns, lengths)
    out = summed.join(_ends_hash(ends), ["depth", "a", "b"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def _ends_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, a, b, conv): the node at which each conversation ends; its hash needs no order."""
    term = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "t1", "t2"))
    whole = turns.groupBy("conv").agg(term(1).alias("a"), term(2).alias("b"))
    zero = F.lit(0).cast("long")
    return lengths.join(whole, "conv", "left").select(F.col("length").alias("depth"), F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), "conv")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The prefix trie of conversations whose heads are shared as ``with_shared_heads`` says; columns as ``prefix_trie`` gives them.

    Turns go by number, null first; equal numbers and repeated rows stay turns of
    their own, in the order of their hashes, so results don't depend on the order
    of rows. Null roles and texts are empty. Rows with a null conversation are
    left out; an empty table has no nodes, not even a root. Other columns are ignored.
    """
    turns = materialize(conversation_turns(conversations, conv_col, turn_col, role_col, text_col), "trie-numbered")
    rebuilt, lengths = with_shared_heads(turns, family, heads)
    rebuilt = materialize(rebuilt, "trie-rebuilt")
    release(turns)
    return prefix_trie(rebuilt, lengths)
