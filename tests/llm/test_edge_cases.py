"""Cases that the docstrings define and no other test has: ties, repeated ids and very long texts."""

import random

from pyspark.sql import functions as F


def test_the_first_of_equal_windows_stays(spark):
    from ledeforge.llm.decontaminate import decontaminate, find_leaks

    rng = random.Random(31)
    item = [f"q{rng.randrange(10_000)}" for _ in range(30)]
    fill = lambda n: [f"f{rng.randrange(10_000)}" for _ in range(n)]
    twice = " ".join([*fill(7), *item, *fill(40), *item, *fill(5)])
    rows = [(1, twice), (1, " ".join(fill(50))), (1, twice), (2, None), (3, ""), (None, twice), (4, " ".join(fill(20_000) + item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "item", "start", "digest", "w", "at")})
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(item)), (12, None), (None, " ".join(item))], "item_id long, text string")
    leaks = find_leaks(docs, bench)
    got = sorted((r["doc_id"] or 0, r["item"], r["start"], r["n_words"], r["similarity"]) for r in leaks.collect())
    assert got == [(0, 10, 7, 30, 1.0), (0, 11, 7, 30, 1.0), (1, 10, 7, 30, 1.0), (1, 11, 7, 30, 1.0), (4, 10, 20_000, 30, 1.0), (4, 11, 20_000, 30, 1.0)]
    kept = decontaminate(docs, leaks).collect()
    assert sorted((r["doc_id"], r["text"] == rows[1][1]) for r in kept) == [(1, True), (2, False), (3, False)]


def test_languages_that_tie_and_long_texts(spark):
    from ledeforge.llm.language_id import build_tables, identify_language

    # both languages know the same word equally often
    tables = build_tables([("same", {"bb": 5, "aa": 5}), ("only", {"bb": 3}), ("solo", {"aa": 3})])
    rows = [(1, "same"), (2, "same same"), (3, "only"), (4, "solo " * 300_000), (5, None), (6, "12 34 _"), (7, ""), (1, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in identify_language(docs, tables).collect())
    assert [g[:2] for g in got] == [(1, "aa"), (1, "bb"), (2, "aa"), (3, "bb"), (4, "aa"), (5, "und"), (6, "und"), (7, "und")]
    assert got[0][2] == 0.5 and got[4][2] == 1.0 and got[5][2] == 0.0


def test_passages_of_rows_that_repeat_an_id(spark):
    from ledeforge.llm.substring_dedup import repeated_passages

    rng = random.Random(33)
    words = lambda n: [f"p{rng.randrange(50_000)}" for _ in range(n)]
    one, two = words(70), words(70)
    rows = [(5, " ".join(words(30) + one)), (5, " ".join(one + words(30))), (8, " ".join(words(20) + one + words(20))), (9, " ".join(two)), (9, " ".join(two)), (None, " ".join(one)), (10, None), (11, "")]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # rows of one id are not compared with each other, those of others are
    assert {(r["doc_id"], r["first_id"]) for r in got} == {(8, 5)}
    assert all(r["start"] == 20 and r["n_words"] == 70 and r["similarity"] == 1.0 for r in got)
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_that_a_refuted_pair_hangs_together_with_is_doubted(spark):
    from ledeforge.llm.jaccard_join import _doubtful

    pairs = lambda *p: spark.createDataFrame(p, "a long, b long")
    none = spark.createDataFrame([], "node long, component long")
    # the smallest node of a component is one of its nodes, and may be the only end of a refuted pair
    assert {r["node"] for r in _doubtful(pairs((0, 1)), spark.createDataFrame([], "a long, b long"), none).collect()} == {0, 1}
    comps = spark.createDataFrame([(6, 5), (8, 7)], "node long, component long")
    got = _doubtful(pairs((5, 9), (7, 8)), pairs((5, 6), (7, 8)), comps)
    assert {r["node"] for r in got.collect()} == {5, 6, 9}


def test_lists_of_the_same_nodes_are_compared_once(spark):
    from ledeforge.llm.jaccard_join import _lists_once

    rows = [(key, node, node // 2, rest + node) for key, rest in ((1, 5), (2, 9), (3, 2)) for node in range(4)]
    rows += [(4, node, node // 2, 7) for node in (0, 1, 2)] + [(5, node, 0, 7) for node in (0, 1)]
    df = spark.createDataFrame(rows, "key long, node long, component long, rest long")
    got = sorted(tuple(r) for r in _lists_once(df, F.count(F.lit(1)) / 2).collect())
    assert got == [(1, n, n // 2, 2, 9 + n) for n in range(4)] + [(4, n, n // 2, 2, 7) for n in (0, 1, 2)]
