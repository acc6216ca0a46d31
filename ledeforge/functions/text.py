"""Text functions of the news pipeline, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledeforge.functions import vocabulary as V


def url_key(url: Column) -> Column:
    """The url without its query and trailing slashes; a fragment before any ``?`` stays."""
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def strip_html(text: Column, limit: int | None = None) -> Column:
    """Tags become spaces, white space single spaces; cut to ``limit`` characters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " "))
    return F.substring(plain, 1, limit) if limit else plain


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _folds() -> dict[str, str]:
    return {form: root for root, forms in V.VERBS.items() for form in forms}


def normal_tokens(text: Column) -> Column:
    """Lower-cased words and digits with tickers and verbs folded, without single characters and stopwords."""
    low = F.replace(F.lower(text), F.lit(","), F.lit(""))
    low = F.regexp_replace(low, r"(?U)(\d)\.0+\b", "$1")
    parts = F.split(F.regexp_replace(low, r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+")
    tickers, verbs = _literal_map(V.TICKERS), _literal_map(_folds())
    folded = F.transform(F.filter(parts, lambda t: F.length(t) >= 2), lambda t: F.coalesce(F.try_element_at(tickers, t), t))
    folded = F.transform(folded, lambda t: F.coalesce(F.try_element_at(verbs, t), t))
    return F.filter(folded, lambda t: ~t.isin(V.STOPWORDS))


def content_tokens(text: Column) -> Column:
    return F.array_distinct(normal_tokens(text))


def entity_tokens(title: Column) -> Column:
    """Capitalised words that name something, with tickers folded, and figures of three digits or more that aren't years."""
    nouns = F.transform(F.regexp_extract_all(title, F.lit("(?U)" + V.PROPER_NOUN), F.lit(1)), F.lower)
    nouns = F.filter(nouns, lambda t: ~t.isin(V.ENTITY_IGNORE))
    tickers = _literal_map(V.TICKERS)
    nouns = F.transform(nouns, lambda t: F.coalesce(F.try_element_at(tickers, t), t))
    numbers = F.transform(F.regexp_extract_all(title, F.lit(r"(\d[\d,]*)"), F.lit(1)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    numbers = F.filter(numbers, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^(19|20)\d\d$"))
    return F.array_distinct(F.concat(nouns, numbers))
