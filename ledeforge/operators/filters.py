"""Hard filters over news items: what is rejected, when, and how many a source may keep."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import any_of, has


def is_clickbait(title: Column) -> Column:
    return any_of(title, V.CLICKBAIT)


def is_price_tick(title: Column) -> Column:
    """A bare price move without a continuation."""
    return any_of(title, [V.TICK_LEAD + V.TICK_PRICE, *V.TICK_OTHERS]) & ~has(title, V.CONTINUATION)


def is_macro_offtopic(title: Column) -> Column:
    """General news; anything relevant wins."""
    return ~any_of(title, V.MACRO_RELEVANT) & any_of(title, V.MACRO_OFFTOPIC)


def reject_reason(title: Column, bucket: Column) -> Column:
    """Why an item is dropped, else null."""
    blank = F.coalesce(F.length(F.regexp_replace(title, r"(?U)^\s+|\s+$", "")), F.lit(0)) < V.MIN_TITLE
    return (
        F.when(blank, "no_title")
        .when(is_clickbait(title), "clickbait")
        .when(is_price_tick(title), "price_tick")
        .when((bucket == "macro") & is_macro_offtopic(title), "macro_offtopic")
    )


def well_formed(items: DataFrame) -> DataFrame:
    """Items with a title and an http address; others vanish uncounted."""
    return items.filter((F.length(F.trim(F.coalesce("title", F.lit("")))) > 0) & F.col("url").startswith("http"))


def within_window(items: DataFrame, now: Column, hours: Column | int = V.WINDOW_HOURS) -> DataFrame:
    """Items no older than ``hours``; the boundary stays."""
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return items.filter(F.col("published_at") >= now - F.make_dt_interval(F.lit(0), hours))


def cap_per_source(items: DataFrame, cap: int = V.MAX_PER_SOURCE, group: Iterable[str] = ("source",), order: str = "seq") -> DataFrame:
    """Items with a ``reject`` column, as far as each source is read: nothing after its ``cap``-th kept one.

    ``order`` is unique within a source. Only the first ``cap`` kept items of each
    source are ranked, to find where reading ends; the items themselves are never
    sorted, so a source of very many items stays spread over all tasks.
    """
    group = list(group)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    kept = items.filter(F.col("reject").isNull()).select(*group, order).withColumn("_place", place).filter(F.col("_place") <= cap)
    ends = kept.filter(F.col("_place") == cap).select(*(F.col(g).alias(f"_{g}") for g in group), F.col(order).alias("_end"))
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group))
    return items.join(ends, same, "left").filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).select(*items.columns)


def category_filter(items: DataFrame, enabled: Iterable[str] | None) -> DataFrame:
    """Items in the enabled categories; none, an empty choice or all of them mean no filter, and else null drops out."""
    chosen = set(enabled or ())
    if not chosen or chosen >= set(V.CATEGORIES):
        return items
    return items.filter(F.col("category").isin(sorted(chosen)))


def category_semi_join(items: DataFrame, prefs: DataFrame) -> DataFrame:
    """Items that any reader of ``prefs`` (chat_id, categories) wants."""
    wanted = prefs.select(F.explode("categories").alias("category")).distinct()
    return items.join(wanted, "category", "left_semi")
