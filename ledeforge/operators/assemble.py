"""Messages of bounded length from ordered blocks of text.

Which message a block belongs to depends on the lengths before it, so lengths
are folded in order, as a stream over sorted rows with one running length a
key; texts are then joined per (key, message), which holds ``limit`` characters
at most. So neither a reader's whole text nor a key's rows are ever in one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.runtime import input_partitions

BETWEEN = "\n\n"


def pieces(blocks: DataFrame, limit: int = V.MESSAGE_LIMIT) -> DataFrame:
    """``blocks`` (..., ord, text) with blocks of more than ``limit`` characters cut hard; adds ``cut``, the piece's number. Null and empty blocks go."""
    n = F.length("text")
    last = F.floor((n - 1) / limit).cast("int")
    rest = [c for c in blocks.columns if c != "text"]
    rows = blocks.filter(n > 0).select(*rest, "text", F.explode(F.sequence(F.lit(0), last)).alias("cut"))
    return rows.select(*rest, "cut", F.substring("text", F.col("cut") * limit + 1, F.lit(limit)).alias("text"))


def message_starts(lengths: np.ndarray, room: int, limit: int, gap: int) -> np.ndarray:
    """Marks the blocks that begin a message; the first ``room`` characters go on with the message before. One search a message."""
    out = np.zeros(len(lengths), dtype=bool)
    total = np.concatenate([[0], np.cumsum(lengths + gap)])
    at = int(np.searchsorted(total, room + gap, "right")) - 1
    while at < len(lengths):
        out[at] = True
        at = int(np.searchsorted(total, total[at] + limit + gap, "right")) - 1
    return out


def numbered(rows: DataFrame, keys: list[str], limit: int = V.MESSAGE_LIMIT) -> DataFrame:
    """``rows`` (keys, ord, cut, text) with ``part``, the message from 0 that each goes to."""
    gap = len(BETWEEN)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, used = None, 0, 0
        for b in batches:
            n = b.column("_n").to_numpy()
            names = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            new = np.array([k > 0 and names[k] != names[k - 1] for k in range(len(names))], dtype=bool)
            edges = [0, *np.flatnonzero(new).tolist(), len(names)]
            parts = np.zeros(len(names), dtype=np.int32)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if names[lo] != key:
                    key, part, used = names[lo], -1, limit
                starts = message_starts(n[lo:hi], limit - used, limit, gap)
                parts[lo:hi] = part + np.cumsum(starts)
                part = int(parts[hi - 1])
                first = int(np.flatnonzero(starts)[-1]) if starts.any() else 0
                own = n[lo + first : hi]
                used = int(own.sum()) + gap * len(own) + (0 if starts.any() else used)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts)], names=[*b.schema.names, "part"])

    dealt = rows.withColumn("_n", F.length("text").cast("long")).repartition(input_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "ord", "cut")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(fold, f"{schema}, part int").drop("_n")


def assemble(blocks: DataFrame, keys: list[str], limit: int = V.MESSAGE_LIMIT) -> DataFrame:
    """(keys, part, text): the blocks (keys, ord, text) of each key, in order, packed greedily into messages of up to ``limit`` characters with a blank line between; ``ord`` is unique within a key."""
    rows = numbered(pieces(blocks, limit), keys, limit)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "cut", "text"))), lambda b: b["text"])
    return rows.groupBy(*keys, "part").agg(F.array_join(ordered, BETWEEN).alias("text"))
