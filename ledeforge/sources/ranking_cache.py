"""The cache of rankings, and which requests it serves.

A ranking is kept under what it depends on, the signature, as a version: a
Parquet folder that is written once and never changed. Which version a chat has,
and since when, is a row of a keyed log; a new ranking swaps the row. A chat is
served its version while it is younger than the age limit and its signature is
still that of the request; a changed setting therefore misses by itself, and
``invalidate`` drops the row besides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.runtime import hadoop_path
from ledeforge.sources.keyed_log import KeyedLog
from ledeforge.streaming.alerts import fire_once


class RankingCache:
    """Rankings under ``path``, served for ``ttl_minutes``; ``chat_type`` is the type of chat ids."""

    def __init__(self, spark: SparkSession, path: str, ttl_minutes: int = V.CACHE_TTL_MINUTES, chat_type: str = "string"):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl_minutes
        self.pointers = KeyedLog(spark, f"{self.path}/pointers", f"chat_id {chat_type}, signature string, version string", ["chat_id"])

    def remember(self, chats: DataFrame, ranked: DataFrame, at: Column) -> str:
        """Stores ``ranked`` (signature, ...) and points ``chats`` (chat_id, signature) to it. Rows are written before the pointers, so no pointer leads nowhere."""
        version = uuid.uuid4().hex
        ranked.write.partitionBy("signature").parquet(f"{self.path}/versions/{version}")
        self.pointers.put(chats.select("chat_id", "signature", F.lit(version).alias("version")), at)
        return version

    def invalidate(self, chats: DataFrame, at: Column) -> None:
        """Forgets the rankings of ``chats`` (chat_id)."""
        self.pointers.remove(chats, at)

    def _young(self, now: Column) -> Column:
        return F.unix_micros(now) - F.unix_micros("at") < self.ttl * 60_000_000

    def lookup(self, asked: DataFrame, now: Column) -> DataFrame:
        """``asked`` (chat_id, signature, ...) with ``version``, null where nothing fresh is kept. At exactly the age limit a ranking has expired."""
        kept = self.pointers.latest().filter(self._young(now)).select("chat_id", "signature", "version")
        return asked.join(kept, ["chat_id", "signature"], "left")

    def items(self, hits: DataFrame) -> DataFrame:
        """(chat_id, ranked items) of looked-up chats that have a version; only their versions and signatures are read."""
        wanted = hits.filter(F.col("version").isNotNull()).select("chat_id", "signature", "version")
        versions = [r["version"] for r in wanted.select("version").distinct().collect()]  # the runs of the last minutes
        if not versions:
            raise LookupError("none of the chats has a fresh ranking")
        rows = None
        for v in versions:
            one = self.spark.read.parquet(f"{self.path}/versions/{v}").withColumn("version", F.lit(v))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        return wanted.join(rows, ["signature", "version"]).drop("version")

    def expire(self, now: Column) -> int:
        """Deletes versions that no pointer could serve any more, and folds the pointers; gives how many versions went."""
        self.pointers.compact()
        kept = {r["version"] for r in self.pointers.latest().filter(self._young(now)).select("version").distinct().collect()}
        fs, root = hadoop_path(self.spark, f"{self.path}/versions")
        old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in kept] if fs.exists(root) else []
        for p in old:
            fs.delete(p, True)
        return len(old)


def served(requests: DataFrame, changes: DataFrame, ttl_minutes: int = V.CACHE_TTL_MINUTES, order: str = "seq") -> DataFrame:
    """``requests`` (chat_id, signature, ts, seq, ...) with ``hit``: whether a cache that ranks anew on every miss would serve them.

    A request hits if the chat's last miss had the same signature and is younger
    than the limit, and no row of ``changes`` (chat_id, ts, seq) came since. So a
    miss is a row that fires: the first of a stretch of one signature without a
    change, and then each that is the limit or more after the one before.
    """
    cols = requests.columns
    changed = changes.select("chat_id", "ts", order, F.lit(True).alias("_change"))
    both = requests.withColumn("_change", F.lit(False)).unionByName(changed, allowMissingColumns=True)
    by_time = Window.partitionBy("chat_id").orderBy("ts", order)
    # a new stretch begins at a change, and where the signature differs from that of the request before
    before = F.last(F.when(~F.col("_change"), F.col("signature")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    turn = F.col("_change") | ~F.coalesce(before == F.col("signature"), F.lit(False))
    cut = both.withColumn("_stretch", F.count_if(turn).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    rows = cut.filter(~F.col("_change")).drop("_change").withColumn("_key", F.struct("chat_id", "_stretch").cast("string"))
    fired = fire_once(rows, "_key", "ts", order, ttl_us=ttl_minutes * 60_000_000, mark="_miss")
    return fired.select(*cols, (~F.col("_miss")).alias("hit"))
