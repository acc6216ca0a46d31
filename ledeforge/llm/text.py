"""Text primitives shared by the corpus operators, as column expressions.

White space is ``[\\x20\\x09-\\x0D]`` throughout; only A-Z are lower-cased, so
results don't depend on a Unicode version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \t\n\x0b\f\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` has a fast path for pure ASCII, where both agree."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Maximal runs without white space; null or blank text has none."""
    s = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_RUN))


def lines(c: Column) -> Column:
    """Pieces between newlines; null or empty text is one empty line."""
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def key128(c: Column) -> Column:
    """Two independent 64-bit hashes as one struct: a collision-proof key at corpus scale."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))
