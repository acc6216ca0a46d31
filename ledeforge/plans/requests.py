"""Requests of chats: their ranking, from the cache where it is fresh, and changes of their settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.operators import prefs
from ledeforge.operators.readers import signature, signatures
from ledeforge.runtime import materialize
from ledeforge.sources.market import PrefsStore
from ledeforge.sources.ranking_cache import RankingCache


def rankings(asked: DataFrame, store: PrefsStore, cache: RankingCache, rank: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """(chat_id, signature, hit, ranked items) of every chat of ``asked`` (chat_id), each as its settings want it.

    Chats without a fresh ranking are ranked together, a signature once, by
    ``rank`` (signatures to ranked items with ``signature``), and remembered. A
    chat whose signature selects nothing has no rows.
    """
    chats = asked.select("chat_id").distinct()
    readers = store.get(chats).withColumn("signature", signature(F.col("categories"), F.col("depth")))
    looked = materialize(cache.lookup(readers, now), "asked")
    missed = looked.filter(F.col("version").isNull())
    if not missed.isEmpty():
        cache.remember(missed, rank(signatures(missed.select("chat_id", "categories", "depth"))), now)
    hits = looked.select("chat_id", "signature", F.col("version").isNotNull().alias("hit"))
    return cache.items(cache.lookup(hits, now)).join(hits, ["chat_id", "signature"])


def change_settings(actions: DataFrame, store: PrefsStore, cache: RankingCache, now: Column) -> DataFrame:
    """Applies ``actions`` (chat_id, action), one a chat; gives the settings of the chats that they changed.

    Those are stored and their rankings forgotten, since they were made under the
    old formula. An action that is unknown, or changes nothing, leaves both as they are.
    """
    before = store.get(actions.select("chat_id")).withColumnsRenamed({"categories": "old_categories", "depth": "old_depth"})
    rows = actions.join(before, "chat_id").withColumns({"categories": F.col("old_categories"), "depth": F.col("old_depth")})
    after = prefs.apply_actions(rows, F.col("action"))
    moved = (F.col("categories") != F.col("old_categories")) | (F.col("depth") != F.col("old_depth"))
    changed = materialize(after.filter(moved).select("chat_id", prefs.sane_categories(F.col("categories")).alias("categories"), "depth"), "changed")
    if not changed.isEmpty():
        store.update(changed, now)
        cache.invalidate(changed, now)
    return changed
