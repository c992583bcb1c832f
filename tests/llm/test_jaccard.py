import random
from fractions import Fraction

import numpy as np

import corpus_pipeline as cp
from sketchloom.llm import jaccard


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_stay(texts):
    """The indices that are the smallest of their group: exact shingle sets, similarity 0.8 or more, chained."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or (a and b and 5 * both >= 4 * (len(a) + len(b) - both)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def stay(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in cp.near_duplicate_stage(spark, df.repartition(5), "").select("doc_id").collect()}


def edited(rng, words, edits):
    """Words spread far apart are changed, each costing five shingles."""
    out = list(words)
    for k in range(edits):
        out[3 + k * (len(out) // edits)] = f"x{rng.random()}"
    return out


def test_links_below_the_threshold_are_not_made(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        texts += [" ".join(w), " ".join(edited(rng, w, 11)), " ".join(edited(rng, w, 6))]  # similarity 0.76 and 0.86
    want = brute_stay(texts)
    assert {3 * i + 1 for i in range(60)} <= want and not {3 * i + 2 for i in range(60)} & want
    got = stay(spark, texts)
    assert want <= got  # nothing below 0.8 is deleted


def test_links_of_sets_match_brute_force():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2000, rng.integers(1, 60))) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.95], rng.integers(0, 2000, rng.integers(0, 5))])).astype(np.uint64) for b in base for _ in range(6)]
    child, root = jaccard.similar_links(sets, Fraction(4, 5))
    got = np.arange(len(sets))
    got[child] = root
    want = np.arange(len(sets))
    plain = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if plain[i] and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j]):
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert (got == want).all() and len(set(want)) < len(sets)


def test_no_pair_at_the_threshold_is_lost(spark):
    rng = random.Random(12)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        w = some(9)
        texts += [" ".join(w[:8]), " ".join(w)]  # 4 of 5 shingles
    for n, edits in ((94, 2), (184, 4), (404, 8), (404, 9)):  # 0.8 and a little above or below
        for _ in range(15):
            w = some(n)
            texts += [" ".join(w), " ".join(edited(rng, w, edits))]
    for _ in range(10):  # as sets nearly equal: one half stands six times in one text
        a, b = some(120), some(120)
        texts += [" ".join(a + b), " ".join(a * 6 + b)]
    w = some(300)
    for _ in range(30):  # a chain
        w = edited(rng, w, 5)
        rng.shuffle(texts)
        texts.append(" ".join(w))
    texts += ["", None, " \n", "one", "ONE", "one two", texts[0].upper()]
    assert stay(spark, texts) == brute_stay(texts)


def test_small_tiles_lose_no_link(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(12):
            texts.append(" ".join(edited(rng, w, rng.randrange(1, 6))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = []
    for kinds in ({}, {"most": 300, "tile": 3}):
        by: dict = {}
        for r in jaccard.similar_groups(df, **kinds).collect():
            by.setdefault(r["component_id"], set()).add(r["id"])
        groups.append({min(g) for g in by.values()})
    assert groups[0] == groups[1] == brute_stay(texts)


def test_keys_of_one_node_are_taken_out_across_batches():
    h = [1, 1, 2, 3, 3, 3, 4, 5, 5, 5, 6, 7, 7]
    node = [1, 2, 1, 8, 8, 8, 1, 1, 1, 2, 3, 4, 5]
    for step in (1, 2, 3, 5, 20):
        batches = [jaccard.pa.RecordBatch.from_pydict({"h": h[i : i + step], "node": node[i : i + step]}) for i in range(0, len(h), step)]
        got = [(a, b) for x in jaccard._shared(iter(batches)) for a, b in zip(x["h"].to_pylist(), x["node"].to_pylist(), strict=True)]
        assert got == [(1, 1), (1, 2), (5, 1), (5, 2), (7, 4), (7, 5)]
