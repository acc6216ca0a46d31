"""Threshold alerts with a guard against firing twice.

The batch side keeps a table of (key, marked_at). The streaming side keeps the
last mark of each key as state, until the watermark is past its 48 hours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledeforge.functions import vocabulary as V
from ledeforge.functions.text import url_key
from ledeforge.runtime import hadoop_path, input_partitions

TTL_US = V.ALERT_TTL_HOURS * 3_600_000_000


def due_alerts(ranked: DataFrame, marked: DataFrame, threshold: float | None = None) -> DataFrame:
    """Ranked items at or above the threshold (0 or none: the default) whose key isn't marked, best first."""
    at = threshold or V.ALERT_THRESHOLD
    keyed = ranked.withColumn("key", url_key(F.col("url")))
    return keyed.filter(F.col("score") >= at).join(marked.select("key"), "key", "left_anti").orderBy(F.desc("score"), "seq")


def mark(marked: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The marks after marking ``keys`` now: marking stamps a key anew, and prunes those of 48 hours or more.

    Pruning happens here alone, so an expired key goes on suppressing until the
    next marking of any key.
    """
    fresh = keys.select("key").distinct().select("key", now.alias("marked_at"))
    old = marked.join(fresh.select("key"), "key", "left_anti")
    return old.unionByName(fresh).filter(F.col("marked_at") > now - F.make_dt_interval(F.lit(0), F.lit(V.ALERT_TTL_HOURS)))


def fires(key: np.ndarray, at: np.ndarray, ttl: int, last: int | None) -> np.ndarray:
    """Marks, in rows sorted by key and time, the first of each key and then each that is ``ttl`` or more after the one marked before; ``last`` is the mark that the first key had already.

    All keys jump at once: a marked row's next is found by one search, so the work
    follows the marks and not the rows.
    """
    n = len(at)
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(starts[1:], n)
    run = np.repeat(np.arange(len(starts)), ends - starts)
    # one axis for all runs; a gap of ttl or more counts as ttl, which changes no jump and keeps numbers small
    gap = np.diff(at, prepend=at[0])
    gap[starts] = ttl + 1
    line = np.cumsum(np.minimum(gap, ttl + 1))
    now, stop = starts.copy(), ends.copy()
    if last is not None:
        now[0] = np.searchsorted(at[: ends[0]], last + ttl)
    live = now < stop
    now, stop = now[live], stop[live]
    while len(now):
        out[now] = True
        now = np.searchsorted(line, line[now] + ttl)
        live = now < stop
        now, stop = now[live], stop[live]
    return out


def fire_once(events: DataFrame, key: str = "key", ts: str = "ts", tie: str = "seq", ttl_us: int = TTL_US, mark: str | None = None) -> DataFrame:
    """Rows that fire: no row of the key fired within ``ttl_us`` (48 hours) before, boundary excluded. With ``mark``, all rows with that as a boolean column.

    Rows stream through sorted partitions with the key's last mark as state, so a
    key with a third of all rows needs no memory, and costs a search a mark. Rows
    without a time are left out.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("_k").to_numpy(zero_copy_only=False)
            at = b.column("_t").to_numpy()
            out = fires(names, at, ttl_us, last if names[0] == held else None)
            tail = names == names[-1]
            if (out & tail).any():
                last = int(at[out & tail].max())
            elif names[-1] != held:
                last = None
            held = names[-1]
            rows = b.drop_columns(["_k", "_t"])
            yield rows.append_column(mark, pa.array(out)) if mark else rows.filter(pa.array(out))

    rows = events.withColumns({"_k": F.col(key), "_t": F.unix_micros(ts)}).filter(F.col("_t").isNotNull()).repartition(input_partitions(events.sparkSession), "_k").sortWithinPartitions("_k", "_t", tie)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema]
    return rows.mapInArrow(fold, ", ".join([*fields, f"{mark} boolean"] if mark else fields))


class Guard(StatefulProcessor):
    """The guard of one key: the time of its last mark, kept while it can still suppress.

    A mark suppresses rows of the 48 hours after it. Once the watermark is past
    that, no such row can come, and a timer removes the mark, so the state holds
    the keys of two days however long the stream runs.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _keep(self, at: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.last.update((at,))
        self.handle.registerTimer(-(-(at + TTL_US) // 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Marks that the batch side has made; of several for a key, the latest."""
        at = int(initialState["at"].max())
        if -(-(at + TTL_US) // 1000) > timerValues.getCurrentWatermarkInMs():
            self._keep(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A trigger's rows, which Spark hands over in batches: sorted once, then one search a mark."""
        all_ = pd.concat(list(rows)).sort_values("ts", kind="stable")
        kept = self.last.get()[0] if self.last.exists() else None
        at = all_["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        out, now = [], kept
        digest, loud = (all_["kind"] == "digest").to_numpy(), (all_["score"] >= self.threshold).to_numpy()
        k = 0
        while k < len(at):
            # the next row that changes anything: a digest row, or a loud one beyond the guard
            k += int(np.argmax(m)) if (m := digest[k:] | (loud[k:] & ((at[k:] - now >= TTL_US) if now is not None else True))).any() else len(at)
            if k < len(at):
                if not digest[k]:
                    out.append(k)
                now = int(at[k])
                k += 1
        if now is not None and now != kept:
            if -(-(now + TTL_US) // 1000) > timerValues.getCurrentWatermarkInMs():
                self._keep(now)
            elif self.last.exists():
                self.last.clear()
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "score": all_["score"].to_numpy()[out].astype(float), "ts": all_["ts"].to_numpy()[out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, threshold: float = V.ALERT_THRESHOLD, late: str = "1 hour", marked: DataFrame | None = None) -> DataFrame:
    """A stream of (key, kind, score, ts) as one of the alerts that fire.

    ``kind`` is alert or digest; digest rows mark their key without firing.
    ``marked`` (key, marked_at), the batch side's table, is the state to begin
    with. Rows later than ``late`` behind the newest are dropped, and a mark goes
    once no row that it could suppress can come any more. Needs the RocksDB state
    store (``rocksdb_state``).
    """
    initial = None if marked is None else marked.select("key", F.unix_micros("marked_at").alias("at")).groupBy("key")
    rows = events.select("key", "kind", "score", "ts").withWatermark("ts", late)
    # the others change no state; they have moved the watermark by now
    rows = rows.filter((F.col("kind") == "digest") | (F.col("score") >= threshold)).groupBy("key")
    return rows.transformWithStateInPandas(Guard(threshold), "key string, score double, ts timestamp", "Append", "EventTime", initialState=initial)


def rocksdb_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fresh_rows(items: DataFrame, feeds: DataFrame, slack: str = "0 hours") -> DataFrame:
    """A stream of items as far as they are in their feed's window, behind the newest item of the stream.

    One watermark serves all feeds, so it has the longest window, ``slack`` added;
    feeds of shorter windows are cut before any state sees their rows. ``feeds``
    (label, window_h) is small and static. ``seen_at`` is when a row was fetched;
    the boundary stays.
    """
    longest = feeds.agg(F.max("window_h").alias("h")).first()["h"] or 0  # a row a feed
    sized = items.join(F.broadcast(feeds.select(F.col("label").alias("source"), "window_h")), "source")
    young = F.col("published_at") >= F.col("seen_at") - F.make_dt_interval(F.lit(0), F.col("window_h"))
    return sized.filter(young).drop("window_h").withWatermark("published_at", f"{longest + int(slack.split()[0])} hours")


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a poll of ``stream``: each trigger's rows go to ``handle``; without ``every``, what is there now."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def once(handle: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """``handle`` as a ``foreachBatch`` function that a replayed batch doesn't run again.

    A batch's rows are first written to the ledger under its number, so a retry
    hands over the very rows of the first try; a mark beside them says that
    ``handle`` has returned. Only a handler that dies midway sees a batch twice.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        path, mark = f"{ledger}/rows/batch={batch}", f"{ledger}/done/batch={batch}"
        fs, done = hadoop_path(spark, mark)
        if fs.exists(done):
            return
        if not fs.exists(hadoop_path(spark, f"{path}/_SUCCESS")[1]):
            rows.write.mode("overwrite").parquet(path)
        handle(spark.read.schema(rows.schema).parquet(path), batch)
        fs.mkdirs(done)

    return run
