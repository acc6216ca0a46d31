"""URL rules against an enumeration of all token sets, and pages whose tokens hang together."""

import random
import time
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F


def judged(spark, urls, labels, **how):
    from ledeforge.llm.url_filter import filter_urls, mine_rules

    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("row", "tokens", "bad", "items", "name", "n", "anchor", "host")})
    mined = mine_rules(pages, spark.createDataFrame(labels, "doc_id long, quality int"), **how)
    return mined, {r["page_id"]: r["verdict"] for r in filter_urls(pages, mined).collect()}


def tokens(spark, urls):
    from ledeforge.llm.url_filter import url_tokens

    df = spark.createDataFrame(urls, "page_id long, url string")
    return {r["page_id"]: frozenset(r["t"]) for r in df.select("page_id", url_tokens(F.col("url")).alias("t")).collect()}


def enumerated(toks, labels, least=5, confidence=0.5):
    bad = defaultdict(list)
    for d, q in labels:
        if q is not None and d in toks:
            bad[d].append(q)
    seen, hits = defaultdict(int), defaultdict(int)
    for d, qs in bad.items():
        for n in range(1, len(toks[d]) + 1):
            for c in combinations(sorted(toks[d]), n):
                seen[c] += 1
                hits[c] += min(qs) == 0
    rules = [set(c) for c in seen if hits[c] >= least and hits[c] >= confidence * seen[c]]
    return {d: "block" if any(r <= t for r in rules) else "allow" for d, t in toks.items()}


def test_rules_against_all_token_sets(spark):
    rng = random.Random(12)
    for case in range(3):
        urls, labels = [], []
        for k in range(160):
            a, b, c = rng.choice("xyz"), rng.choice("pqr"), rng.choice(["", "?s=1", "?s=1&t=2", "#f"])
            urls.append((k, f"http://{rng.choice(['u', 'v'])}.net/{a}/{b}{c}"))
            if k < 120:
                rotten = (a == "x" and b == "p") or (case == 1 and c == "#f" and a == "y") or rng.random() < 0.1
                labels.append((k, 0 if rotten else 1))
        labels += [(k, None) for k in range(0, 160, 7)] + [(3, 1), (9999, 0)]
        urls += [(200, None), (201, "no scheme"), (202, "")]
        mined, got = judged(spark, urls, labels)
        assert got == enumerated(tokens(spark, urls), labels)
        assert max(r["n_items"] for r in mined.collect()) >= 2  # x or p alone is no rule


def test_deep_directories_do_not_multiply(spark):
    deep = "/".join(f"d{k}" for k in range(20))
    same = [(k, f"http://h.net/{deep}/{'bad' if k < 12 else 'fine'}") for k in range(72)]
    labels = [(k, int(k >= 12)) for k in range(72)]
    began = time.perf_counter()
    _, got = judged(spark, same, labels)
    assert got == {k: "block" if k < 12 else "allow" for k in range(72)}
    # a chain: each piece holds fewer pages than the one above, so none is in a class with another
    chain = [(k, "http://h.net/" + "/".join(f"d{j}" for j in range(1 + k % 20))) for k in range(400)]
    mined, got = judged(spark, chain, [(k, int(k % 20 < 17)) for k in range(400)])
    assert all(got[k] == "block" for k in range(400) if k % 20 >= 17) and mined.count()
    assert time.perf_counter() - began < 90


def test_rules_of_common_classes_on_long_pages(spark):
    # x and y together are the rule; four keys, each rarer than x and y and no part of a rule, stand on all its pages
    keys, urls, labels = [f"k{j}=1" for j in range(4)], [], []
    for k in range(260):
        x, y = k < 150, k < 40 or k >= 150
        carries = k < 90 or k >= 210
        left_out = {40: 0, 41: 1, 210: 2, 211: 3}.get(k)
        held = [q for j, q in enumerate(keys) if carries and j != left_out]
        urls.append((k, f"http://h.net/{'x' if x else 'u'}/{'y' if y else 'v'}?" + "&".join(held)))
        labels.append((k, int(k >= 40)))
    for most in (4, 40):
        assert judged(spark, urls, labels, max_classes=most)[1] == {k: "block" if k < 40 else "allow" for k in range(260)}
    # the same rules, whichever pages FP-growth takes
    rng = random.Random(3)
    urls = [(k, f"http://h.net/{rng.choice('xu')}/{rng.choice('yv')}?" + "&".join(q for q in keys if rng.random() < 0.7)) for k in range(60)]
    labels = [(k, 0 if ("/x/y" in u and "k0" in u) or rng.random() < 0.15 else 1) for k, u in urls]
    for most in (1, 3):
        assert judged(spark, urls, labels, max_classes=most, min_support=0.1)[1] == enumerated_pairs(tokens(spark, urls), labels, 6)


def enumerated_pairs(toks, labels, least):
    """Verdicts by all rules, looked for breadth first among sets that enough bad pages have."""
    bad, pages = {d for d, q in labels if q == 0}, list(toks)
    level, rules = [frozenset()], []
    while level:
        grown = {s | {t} for s in level for d in pages if s <= toks[d] for t in toks[d] - s}
        level = []
        for s in grown:
            on = [d for d in pages if s <= toks[d]]
            hits = sum(d in bad for d in on)
            if hits >= least and not any(r <= s for r in rules):
                (rules if hits >= 0.5 * len(on) else level).append(s)
    return {d: "block" if any(r <= toks[d] for r in rules) else "allow" for d in pages}


def test_odd_labels_and_empty_tables(spark):
    urls = [(k, f"http://{'good' if k % 3 else 'spam'}.org.net/p") for k in range(20)] + [(0, "http://spam.org.net/p")] * 3
    mined, got = judged(spark, urls, [(k, None) for k in range(20)])
    assert mined.count() == 0 and set(got.values()) == {"allow"}
    assert judged(spark, [], [(1, 0)])[1] == {} and judged(spark, [], [])[1] == {}
    mined, got = judged(spark, urls, [(k, int(k % 3 > 0)) for k in range(20)])
    assert got == {k: "allow" if k % 3 else "block" for k in range(20)}
    # every token that only bad pages have is looked for, though they are one class
    assert {r["anchor"] for r in mined.collect()} == {"label=spam", "domain=spam.org.net"}
