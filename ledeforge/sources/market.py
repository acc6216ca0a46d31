"""Market data, settings and the stores of readers' preferences and messages."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.operators.prefs import parse_prefs, prefs_or_default, sane_categories, sane_depth
from ledeforge.sources.keyed_log import KeyedLog

TICKERS = "array<struct<symbol: string, lastPrice: string, priceChangePercent: string>>"
MOOD = "struct<data: array<struct<value: string, value_classification: string>>>"


def parse_tickers(bodies: DataFrame, col: str = "value") -> DataFrame:
    """(other columns, ord, symbol, price, change_pct) of the known symbols; bodies that don't parse give no rows."""
    keys = [c for c in bodies.columns if c != col]
    rows = bodies.select(*keys, F.posexplode(F.from_json(col, TICKERS)).alias("ord", "r"))
    names = F.create_map(*(F.lit(x) for kv in V.SYMBOLS.items() for x in kv))
    found = rows.select(*keys, "ord", F.try_element_at(names, F.coalesce("r.symbol", F.lit(""))).alias("symbol"), F.expr("try_cast(r.lastPrice AS double)").alias("price"), F.expr("try_cast(r.priceChangePercent AS double)").alias("change_pct"))
    return found.filter(F.col("symbol").isNotNull() & F.col("price").isNotNull())


def parse_mood(bodies: DataFrame, col: str = "value") -> DataFrame:
    """(other columns, fear_greed, fear_greed_label) from the first element, else no row."""
    keys = [c for c in bodies.columns if c != col]
    rows = bodies.select(*keys, F.get(F.from_json(col, MOOD)["data"], F.lit(0)).alias("d"))
    return rows.select(*keys, F.expr("try_cast(d.value AS int)").alias("fear_greed"), F.coalesce("d.value_classification", F.lit("")).alias("fear_greed_label")).filter(F.col("fear_greed").isNotNull())


def market_snapshot(tickers: DataFrame, mood: DataFrame, polls: DataFrame) -> DataFrame:
    """(poll, prices, fear_greed, fear_greed_label) of every poll; what failed is empty or null. A poll's few prices keep the order of its body."""
    price = lambda p: F.struct(p["symbol"].alias("symbol"), p["price"].alias("price"), p["change_pct"].alias("change_pct"))
    prices = tickers.groupBy("poll").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "symbol", "price", "change_pct"))), price).alias("prices"))
    moods = mood.groupBy("poll").agg(F.min_by(F.struct("fear_greed", "fear_greed_label"), "fear_greed").alias("m"))
    none = F.array().cast("array<struct<symbol: string, price: double, change_pct: double>>")
    rows = polls.select("poll").join(prices, "poll", "left").join(moods, "poll", "left")
    return rows.select("poll", F.coalesce("prices", none).alias("prices"), F.col("m.fear_greed").alias("fear_greed"), F.col("m.fear_greed_label").alias("fear_greed_label"))


def load_prefs(spark: SparkSession, path: str) -> DataFrame:
    """Preferences from JSON text files; corrupt text counts as none."""
    return parse_prefs(spark.read.text(path, wholetext=True))


class PrefsStore:
    """Preferences by chat, changed a chat at a time; what one writer sets for its chats stands beside what others set for theirs."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = KeyedLog(spark, path, "chat_id string, categories array<string>, depth string", ["chat_id"])

    def update(self, prefs: DataFrame, at: Column | None = None) -> None:
        """Sets the chats of ``prefs`` (chat_id, categories, depth), cleaned up as they are on reading."""
        clean = prefs.select("chat_id", sane_categories(F.col("categories")).alias("categories"), sane_depth(F.col("depth")).alias("depth"))
        self.log.put(clean, F.current_timestamp() if at is None else at)

    def load(self) -> DataFrame:
        return self.log.latest().drop("at")

    def get(self, chats: DataFrame) -> DataFrame:
        """Every chat of ``chats`` (chat_id) with its preferences, or the default."""
        return prefs_or_default(chats, self.load())


def push(messages: DataFrame, send: Callable[[str, str], None]) -> None:
    """Sends (chat_id, part, text) in order, a row at a time; the sink of small results."""
    for r in messages.orderBy("chat_id", "part").toLocalIterator():
        send(r["chat_id"], r["text"])


@dataclass(frozen=True)
class Settings:
    """What the environment may change; bad values are an error."""

    digest_time: str = V.DIGEST_TIME
    digest_tz: str = V.DIGEST_TZ
    alert_threshold: float = V.ALERT_THRESHOLD
    models: tuple[str, ...] = field(default=())

    @staticmethod
    def load(env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        at = env.get("DIGEST_TIME", V.DIGEST_TIME)
        if not re.fullmatch(r"([01]?\d|2[0-3]):[0-5]\d", at):
            raise ValueError(f"digest time {at!r} is not HH:MM")
        chain = tuple(x.strip() for x in env.get("LLM_CHAIN", "").split(",") if x.strip())
        return Settings(at, env.get("DIGEST_TZ", V.DIGEST_TZ), float(env.get("ALERT_THRESHOLD", V.ALERT_THRESHOLD)), chain)

    def threshold(self, chosen: float | None) -> float:
        """A chat's own threshold, where 0 means none."""
        return chosen or self.alert_threshold
