"""The driver's contract."""

import pytest


def test_catalogue():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 60


@pytest.mark.parametrize("name", ["score_balanced", "edges_rare", "multi_reader_ranking", "alert_dedup_48h", "top_messages", "digest_chain", "why_messages", "rss_parse", "feed_health", "market_snapshot", "prefs_toggle", "cache_hits"])
def test_query_against_sql(spark, sf, name):
    import os

    import duckdb

    import __spark_entry__ as e

    got = e.queries()[name](spark, sf).toPandas()
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    want = c.sql(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, got[cols].astype(object).itertuples(index=False, name=None))) == sorted(map(repr, want[cols].astype(object).itertuples(index=False, name=None)))
