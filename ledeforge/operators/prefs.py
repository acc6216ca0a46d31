"""Reader preferences: parsing, clean-up, changes and their effect on a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V

DEPTHS = tuple(V.DEPTH_SPLITS)
SCHEMA = "map<string, struct<categories: array<string>, depth: string>>"


def _all() -> Column:
    return F.array(*map(F.lit, V.CATEGORIES))


def sane_categories(c: Column) -> Column:
    """Known categories, sorted; all of them where none is left."""
    known = F.sort_array(F.array_distinct(F.array_intersect(F.coalesce(c, F.array().cast("array<string>")), _all())))
    return F.when(F.size(known) == 0, F.sort_array(_all())).otherwise(known)


def sane_depth(d: Column) -> Column:
    return F.when(d.isin(*DEPTHS), d).otherwise("balanced")


def parse_prefs(text: DataFrame, col: str = "value") -> DataFrame:
    """(chat_id, categories, depth) from JSON maps; text that doesn't parse has no readers."""
    rows = text.select(F.explode(F.from_json(col, SCHEMA)).alias("chat_id", "p"))
    return rows.select("chat_id", sane_categories(F.col("p.categories")).alias("categories"), sane_depth(F.col("p.depth")).alias("depth"))


def prefs_or_default(chats: DataFrame, prefs: DataFrame) -> DataFrame:
    """Every chat with its preferences, or all categories and balanced."""
    joined = chats.join(prefs, "chat_id", "left")
    return joined.select("chat_id", F.coalesce("categories", F.sort_array(_all())).alias("categories"), F.coalesce("depth", F.lit("balanced")).alias("depth"))


def toggle(categories: Column, category: Column) -> Column:
    """The set without the category if it had it, else with it; sorted, unknown names ignored."""
    flipped = F.when(F.array_contains(categories, category), F.array_remove(categories, category)).otherwise(F.array_union(categories, F.array(category)))
    return F.sort_array(F.when(F.array_contains(_all(), category), flipped).otherwise(categories))


def apply_actions(prefs: DataFrame, action: Column) -> DataFrame:
    """One ``name:value`` action on every row: cat, depth or all; others change nothing."""
    parts = F.split(action, ":", 2)
    name, value = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    cats = F.when(name == "cat", toggle(F.col("categories"), value)).when(name == "all", F.sort_array(_all())).otherwise(F.col("categories"))
    depth = F.when((name == "depth") & value.isin(*DEPTHS), value).otherwise(F.col("depth"))
    return prefs.withColumns({"categories": cats, "depth": depth})


def to_json(prefs: DataFrame) -> DataFrame:
    return prefs.select("chat_id", F.to_json(F.struct(F.sort_array("categories").alias("categories"), "depth")).alias("json"))


def depth_coverage(selected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, numeric, analysis): selected items that carry figures and framing."""
    carries = lambda n: F.count_if(F.col(f"raw_{n}") > 0).alias(n)
    return selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), carries("numeric"), carries("analysis"))
