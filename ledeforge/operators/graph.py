"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeforge.runtime import materialize, release


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another, but the smallest of its component, which names it.

    Alternates large-star and small-star steps, which hang every neighbour on
    the smallest one, until the edges no longer change; the number of rounds is
    logarithmic in practice. Minima are taken by aggregation with map-side
    combine and joined back, so a node with very many edges is never collected.
    Each round is written to the shared folder. Null ends and loops are ignored.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a") != F.col("b")).distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, "components")
        if before is not None:
            release(before)
        before = e
        # done when every node hangs on one that hangs on none
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(e.select("b", F.lit(0), F.lit(1))).groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.filter((F.col("up") > 1) | (F.col("up") + F.col("root") > 1)).isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
