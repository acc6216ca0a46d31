"""Importance sampling, conversation tries and fingerprint trees against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

VOCAB = [f"w{k}" for k in range(60)] + ["Été", "ÀB", "naïve", "x1y2"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ---- importance sampling ----


def sampled(docs, bench, n=1, buckets=10_000, least=20, percent=10):
    """(n_features, weight, score, rank) by id; ids are unique."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs(words(t))]
    s, t = np.zeros(buckets), np.zeros(buckets)
    mine = {d: bucket(x) for d, x in docs}
    for b in mine.values():
        np.add.at(s, b, 1)
    for x in bench:
        np.add.at(t, bucket(x), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    out = {}
    for d, b in mine.items():
        weight = sum(gain[k] for k in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    may = sorted((d for d, x in docs if len(words(x)) >= least), key=lambda d: (-out[d][2], d))
    rank = {d: k + 1 for k, d in enumerate(may[: percent * len(may) // 100])}
    return {d: (*v, rank.get(d)) for d, v in out.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(VOCAB) for _ in range(n))
    rows = [(k, text(rng.choice([3, 19, 20, 21, 60, 300]))) for k in range(150)]
    return [*rows, (150, None), (151, ""), (152, " \t.,"), (153, text(90_000)), (154, rows[3][1])]


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (2, 37), (1, 100), (1, 0)])
def test_importance_sample(spark, texts, n, percent):
    from ledeforge.llm.importance import importance_sample

    bench = [" ".join(VOCAB[:9]), "w1 w1 w2", None]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"weight": F.lit(1), "score": F.lit("x"), "id": F.lit(0)})
    got = importance_sample(docs, spark.createDataFrame([(b,) for b in bench], "text string"), max_run=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got} == sampled(texts, bench, n, percent=percent)


def test_importance_of_odd_tables(spark):
    from ledeforge.llm.importance import importance_sample

    text = " ".join(VOCAB[:25])
    bench = spark.createDataFrame([], "text string")
    rows = [(7, text)] * 60 + [(None, text), (8, "too short"), (9, text + " more")]
    got = importance_sample(spark.createDataFrame(rows, "doc_id long, text string"), bench, percent=50).collect()
    assert len(got) == 63
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 31))  # alike rows rank side by side; the row without an id doesn't count
    assert [r["score"] for r in got if r["doc_id"] is None] == [None]
    assert importance_sample(spark.createDataFrame([], "doc_id long, text string"), bench).collect() == []


def test_one_score_of_very_many_ranks_by_id(spark):
    from ledeforge.llm.importance import top_share

    rows = [(k, 5 if k % 3 else 9) for k in range(300)]
    got = top_share(spark.createDataFrame(rows, "doc_id long, score long"), F.lit(True), 50).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:150]
    assert sorted((r["rank"], r["doc_id"]) for r in got if r["rank"]) == [(k + 1, r[0]) for k, r in enumerate(want)] and len(got) == 300


# ---- conversation tries ----


def trie(rows, family=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    members, kids, ends, last = defaultdict(list), defaultdict(set), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        whole = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
            last[whole[:d]] = len(whole[d - 1][1].encode()) if d else 0
            if d:
                kids[whole[: d - 1]].add(whole[:d])
        ends[whole].append(c)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * last[p]
    for p, m in members.items():
        up = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), up, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return out


def tried(spark, rows):
    from ledeforge.llm.conversation_trie import conversation_trie

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "pos", "a", "b", "depth", "path", "bytes")})
    got = [tuple(r) for r in conversation_trie(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_against_plain_python(spark):
    rng, rows = random.Random(6), []
    for c in [*range(0, 60), 903, 904, -7, 10**15]:
        n = rng.randrange(1, 14)
        # few texts, so that conversations share paths beyond their families; some have no turn numbers
        rows += [(c, k, rng.choice(["user", None]), rng.choice(["hé", "hé", "", None, "yes"])) for k in range(n)]
    rows += [(70, None, "user", "first"), (70, -1, "user", "second"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    assert tried(spark, rows) == trie(rows)


def test_trie_of_copies_chains_and_empty_tables(spark, monkeypatch):
    from ledeforge.llm import conversation_trie as C

    monkeypatch.setattr(C, "PART", 4)  # paths and lists of ids go over many parts
    rows = [(c, k, "u", "same") for c in range(40) for k in range(12)]
    rows += [(c, k, "u", f"t{k}" if k < c - 100 else f"own{c}") for c in range(100, 118) for k in range(25)]  # one branch at each depth
    assert tried(spark, rows) == trie(rows)
    assert tried(spark, []) == set()
    # repeated rows and equal numbers are turns of their own
    got = tried(spark, [(0, 3, "u", "ab")] * 3)
    assert {r[1]: r[3] for r in got} == {0: 1, 1: 1, 2: 1, 3: 1}


def test_peeling_takes_few_rounds(spark, monkeypatch):
    """A comb of 200 teeth is 200 deep, and peels in rounds that follow its logarithm."""
    from ledeforge.llm import conversation_trie as C

    rounds, plain = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, tag, *a: (rounds.append(tag), plain(df, tag, *a))[1])
    turns = spark.range(200).selectExpr("id conv", "explode(sequence(1L, id + 1)) depth").selectExpr("conv", "depth", "xxhash64(if(depth = conv + 1, conv, -1L)) t1", "xxhash64(7L, if(depth = conv + 1, conv, -1L)) t2", "1L bytes")
    out = C.prefix_trie(turns, spark.range(200).selectExpr("id conv", "id + 1 length"))
    root = out.filter("depth = 0").first()
    assert (root["n_convs"], root["n_leaves"]) == (200, 200)
    assert rounds.count("trie-ready") <= 24


# ---- fingerprints ----


def plain_print(text, width=3):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(items, radius):
    """The least item (by place) that links reach."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= radius:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(items))]


def cluster(rng, n, spread):
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(spread))}) for _ in range(n)]


def test_fingerprints(texts):
    from ledeforge.llm.simhash_trees import fingerprint

    for _, t in [*texts[:60], (0, None), (0, ""), (0, "  \n"), (0, "one"), (0, "ONE two"), (0, "one two one two one two"), (0, texts[153][1])]:
        assert fingerprint(t) & (2**64 - 1) == plain_print(t)


def test_trees_follow_every_pair_within_the_radius():
    from ledeforge.llm.simhash_trees import Tree, joined

    rng = random.Random(9)
    items = list(dict.fromkeys([rng.getrandbits(64) for _ in range(80)] + cluster(rng, 150, 6) + [0, 2**64 - 1, 1, 3]))
    arr = np.array(items, dtype=np.uint64)
    tree = Tree(arr)
    assert sorted(tree.child.tolist()) == list(range(1, len(items)))  # every item but the root hangs on one edge
    for radius in (0, 1, 2, 5):
        row, node = tree.within(arr, radius)
        want = {(i, j) for i in range(len(items)) for j in range(len(items)) if (items[i] ^ items[j]).bit_count() <= radius}
        assert set(zip(row.tolist(), node.tolist(), strict=True)) == want and len(row) == len(want)
        assert joined(arr, radius).tolist() == reached(items, radius)


def test_near_fingerprints_on_every_level(spark):
    from ledeforge.llm.simhash_trees import near_fingerprints
    from ledeforge.operators.graph import connected_components

    rng = random.Random(10)
    items = sorted(set([rng.getrandbits(64) for _ in range(300)] + cluster(rng, 250, 7) + cluster(rng, 40, 3) + [0, 1, 7, 2**64 - 1]))
    want = reached(items, 2)
    signed = [x - 2**64 if x >> 63 else x for x in items]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for shard, largest in ((1024, 8192), (16, 40), (8, 3)):  # none, some and most shards are dealt anew
        comps = {r["node"]: r["component"] for r in connected_components(near_fingerprints(df, 2, shard, largest)).collect()}
        got = [comps.get(x, x) for x in signed]
        groups, same = defaultdict(set), defaultdict(set)
        for k, x in enumerate(signed):
            groups[got[k]].add(x)
            same[want[k]].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


def test_simhash_components(spark, texts):
    from ledeforge.llm.simhash_trees import simhash_components

    rng = random.Random(11)
    base = [rng.choice(VOCAB) + str(k) for k in range(900)]
    near = []
    for k in range(12):
        w = list(base)
        w[rng.randrange(900)] = f"new{k}"
        near.append((500 + k, " ".join(w)))
    rows = [*texts, *near, (400, near[0][1]), (601, "a b"), (600, "A  b"), (5, near[1][1])]  # id 5 stands twice, by two texts
    fps = [plain_print(t) for _, t in rows]
    root = reached(fps, 2)
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    want = sorted((d, f"{fps[k]:016x}", least[root[k]]) for k, (d, _) in enumerate(rows))
    df = spark.createDataFrame([*rows, (None, near[0][1])], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "id", "component", "least")})
    got = simhash_components(df).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert [(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is None] == [(f"{plain_print(near[0][1]):016x}", None)]
    assert len({r[2] for r in want if 500 <= r[0] < 512}) < 12
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
