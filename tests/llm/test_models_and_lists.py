"""Trees against a walk row by row, counts of odd vocabularies, and passages in long lists."""

import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F


def test_array_traversal_equals_a_walk():
    from ledeforge.llm.quality_model import fit_trees

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 6)), 1)  # rounded, so that values tie with thresholds
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] <= -0.1)).astype(float)
    t = fit_trees(x, y, trees=25)
    assert len(t.roots) == 25 and np.isin(x[:, t.feature[t.roots[0]]], t.threshold).any()

    def walk(row):
        total = t.base
        for at in t.roots.tolist():
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        return total

    fresh = np.vstack([x, np.round(rng.normal(size=(200, 6)), 1), np.zeros((1, 6))])
    assert np.allclose(t.margin(fresh), [walk(r) for r in fresh], rtol=0, atol=1e-12)
    assert ((t.score(x) >= 0.5) == (y > 0.5)).mean() > 0.97
    assert np.allclose(fit_trees(np.zeros((0, 6)), np.zeros(0)).score(fresh), 0.5)


def test_quality_of_ties_repeated_rows_and_clashing_names(spark):
    from ledeforge.llm.quality_model import fit_quality, quality_scores

    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "garden", "winter", "letter"]) for _ in range(60)) + "."
    rows = [(k, good() if k % 2 else "@@ $$ 11 " * 30) for k in range(120)]
    docs = spark.createDataFrame(rows + rows[:10], "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "_y": F.lit(0), "id": F.lit(0)})
    labels = [(k, k % 2) for k in range(120)] + [(1, 0), (1, 1), (3, None)]
    model = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality_scores(docs, model).collect()
    assert len(got) == 130
    scores = {}
    for r in got:
        assert scores.setdefault(r["text"], r["score"]) == r["score"]  # equal texts tie
        assert r["predicted"] == int(r["score"] >= 0.3)
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)


def test_vocabularies_without_a_byte_are_refused(tmp_path):
    from ledeforge.llm.token_count import PairMerger

    spec = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    lost = next(s for s in spec["model"]["vocab"] if len(s) == 1)
    del spec["model"]["vocab"][lost]
    spec["model"]["merges"] = []
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="no symbol"):
        PairMerger(str(tmp_path / "v.json"))


def test_token_counts_of_no_rows(spark):
    from ledeforge.llm.token_count import count_tokens

    got = count_tokens(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json"))
    assert got.collect() == [] and {"n_bytes", "n_tokens", "over_limit"} <= set(got.columns)


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    from ledeforge.llm import shingles as S

    rng, seen = random.Random(1), {}
    for chunk in (1 << 16, 64):
        monkeypatch.setattr(S, "CHUNK", chunk)
        for _ in range(150):
            t = "".join(rng.choice(["a", "B", "é", "   ", "\n", "\x0b", "ß", "　", "x" * rng.choice([1, 90])]) for _ in range(rng.randrange(0, 300)))
            words, h = t.encode().lower().split(), S.word_hashes(t)
            assert len(words) == len(h)
            assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) > 1000


def test_alike_runs_share_one_of_the_rarest():
    from ledeforge.llm.substring_dedup import rarest

    rng = np.random.default_rng(2)
    for _ in range(60):
        width, percent = 46, 80
        near = rng.integers(0, 10**6, 2 * width + 1)
        near[rng.integers(0, len(near), 3)] = near[0]  # some shingles repeat
        often = rng.integers(1, 5, len(near))
        often = np.array([often[np.flatnonzero(near == c)[0]] for c in near])
        chosen = set(rarest(near, often, width, width, percent).tolist())
        x = int(rng.integers(1, width + 1))  # a run about the middle
        run = np.unique(near[x : x + width])
        drop = rng.choice(run, len(run) - -(-percent * len(run) // 100), replace=False)
        shared = set(run.tolist()) - set(drop.tolist())
        # whatever the other run lacks, one of those asked for is left, unless it stands nowhere else
        alone = {c for c, n in zip(near.tolist(), often.tolist(), strict=True) if n == 1}
        assert shared & chosen or shared & alone


@pytest.mark.parametrize("phrase", [40, 44])
def test_exact_passages_beside_a_common_phrase(spark, phrase, monkeypatch):
    """Every list of the phrase's minima is long, and the passage stands in two documents alone."""
    from ledeforge.llm import substring_dedup as S

    monkeypatch.setattr(S, "LONG", 64)
    rng = random.Random(phrase)
    words = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    common = words(phrase)
    docs = [words(60) + common + words(60) for _ in range(400)]
    ids, pairs = list(range(400)), []
    rng.shuffle(ids)
    for p in range(60):
        a, b = ids[2 * p], ids[2 * p + 1]
        left = rng.randrange(51 - phrase)
        before, after = words(left), words(50 - phrase - left)
        for d in (a, b):
            docs[d][60 - left : 60] = before
            docs[d][60 + phrase : 110 - left] = after
        pairs.append((max(a, b), min(a, b)))
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)] + [(None, "lost"), (7, None)]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "key", "row", "cell")})).collect()
    flagged = {r["doc_id"] for r in got}
    assert sum(b in flagged for b, _ in pairs) == 60
    if phrase == 40:  # beside longer phrases the smallest document's shorter run is alike as well
        found = {(r["doc_id"], r["first_id"]) for r in got}
        assert sum(p in found for p in pairs) >= 58
    for r in got:
        assert r["n_words"] >= 50 and r["similarity"] >= 0.8 and r["first_id"] < r["doc_id"]


def test_common_shingles_bring_the_rows_of_a_list_together_once(spark):
    """Rows of one list that share 40 shingles met once for each of those that were asked for, with a copy of their surroundings each time."""
    from ledeforge.llm.substring_dedup import _filed_anew, _retried

    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    common, n = fresh(40), 100
    texts = [np.concatenate([fresh(26), common, fresh(27)]) for _ in range(n)]
    texts[90][20:70] = texts[60][20:70]  # a longer passage of two of them
    members = spark.createDataFrame([(7, k, 0, 46, 92, 0, k > 0) for k in range(n)], "key long, id long, l int, c int, r int, fn int, open boolean")
    shingles = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "id long, s binary")
    anew = _filed_anew(members, shingles, 46, 80)
    rows = anew.collect()
    own = [r for r in rows if r["key"] != 7]  # what two rows have beyond the phrase
    assert sorted(r["id"] for r in rows if r["key"] == 7) == list(range(n)) and {r["id"] for r in own} <= {60, 90}
    found = lambda m: {(r["a"], r["b"]) for f in _retried(m, shingles, 46, 80) for r in f.collect()}
    plain = found(members)
    assert {b for _, b in plain} == set(range(1, n)) and plain <= found(anew)


def test_verdicts_are_those_of_the_runs_themselves():
    from ledeforge.llm.substring_dedup import Verdicts, best_runs

    rng = np.random.default_rng(9)
    verdicts, seen = Verdicts(10, 80, most=50), [0, 0]
    for _ in range(150):
        own = rng.integers(0, 60, 21, dtype=np.uint32)  # some shingles repeat
        others = []
        for _ in range(6):
            y = rng.integers(60, 90, 25, dtype=np.uint32)
            lo, n = int(rng.integers(0, 10)), int(rng.integers(6, 12))
            y[3 : 3 + n] = own[lo : lo + n]
            y[rng.integers(0, 25, 2)] = rng.integers(0, 90, 2)
            others.append(y)
        want = [k for k, y in enumerate(others) if any(lo <= 10 <= hi for _, _, lo, hi, _ in best_runs(y, own, 10, 80))]
        assert verdicts.first(own, 10, others, 9) == want and verdicts.first(own, 10, others, 1) == want[:1]
        seen[0] += len(want)
        seen[1] += len(others) - len(want)
    assert min(seen) > 100, seen


def test_what_a_list_has_in_common_is_not_joined_row_by_row(spark, monkeypatch):
    """Every place around the minimum of an open row was joined with its count, those of the list's phrase included."""
    from ledeforge.llm import substring_dedup as S

    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    common, n, seen, keep = fresh(40), 100, [], S.bounded_broadcast
    texts = [np.concatenate([fresh(26), common, fresh(27)]) for _ in range(n)]
    texts[90][20:70] = texts[60][20:70]
    members = spark.createDataFrame([(7, k, 0, 46, 92, 0, k > 0) for k in range(n)], "key long, id long, l int, c int, r int, fn int, open boolean")
    shingles = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "id long, s binary")

    def counted(df, *rest):
        if {"cell", "often"} <= set(df.columns):
            seen.append(df.agg(F.max("often")).first()[0])
        return keep(df, *rest)

    monkeypatch.setattr(S, "bounded_broadcast", counted)
    rows = S._filed_anew(members, shingles, 46, 80).collect()
    assert sorted(r["id"] for r in rows if r["key"] == 7) == list(range(n)) and {r["id"] for r in rows if r["key"] != 7} == {60, 90}
    assert seen and max(seen) == 2


def test_rarest_cells_without_repeats_and_runs_in_blocks(monkeypatch):
    from ledeforge.llm import substring_dedup as S

    rng = np.random.default_rng(4)
    for _ in range(30):
        cells, often = rng.permutation(10**6)[:93], rng.integers(1, 6, 93)
        want, order = set(), np.lexsort((cells, often))
        rank = np.argsort(order)
        for x in range(1, 47):
            want |= {int(cells[p]) for p in x + np.argsort(rank[x : x + 46])[:10] if often[p] > 1}
        assert S.rarest(cells, often, 46, 46, 80).tolist() == sorted(want)
    pairs = [(rng.integers(0, 400, 90, dtype=np.uint32), rng.integers(300, 700, 120, dtype=np.uint32)) for _ in range(20)]
    for a, b in pairs:
        b[30:60] = a[20:50]
    whole = [S.best_runs(a, b, 10, 80) for a, b in pairs]
    monkeypatch.setattr(S, "TABLE", 8)
    assert [S.best_runs(a, b, 10, 80) for a, b in pairs] == whole and sum(map(len, whole)) >= 20
