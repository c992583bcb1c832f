import math

import numpy as np
from sketchloom.llm import ann

QUERY = "id % 50 = 0"


def brute(ids, x, k=5):
    out = {}
    n = np.linalg.norm(x, axis=1)
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / (n * n[i])
        rows = [j for j in range(len(ids)) if ids[j] != ids[i]]
        rows.sort(key=lambda j: (-round(s[j], 12), ids[j]))
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in rows[:k]]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v], 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, score int")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[10:20] = x[0]  # ties
    ids = np.arange(3000)
    got = {}
    for r in ann.nearest(frame(spark, ids, x).repartition(7), QUERY, max_fit=1000, block_rows=700).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(ids, x.astype(np.float64))
    assert set(got) == set(want) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({a for a, _ in got[q].values()} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [got[0][r][0] for r in range(1, 6)] == [10, 11, 12, 13, 14]
    xd = x.astype(np.float64)
    for q, v in got.items():
        for i, s in v.values():
            assert abs(s - xd[q] @ xd[i] / np.linalg.norm(xd[q]) / np.linalg.norm(xd[i])) < 1e-12


def some_codes(seed, n=500, m=8):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 1 << 16, (n, m)).astype(np.uint16)
    near = codes[:50].copy()
    for row in near:
        for b in rng.integers(0, 16 * m, rng.integers(0, 60)):
            row[b // 16] ^= np.uint16(1 << (b % 16))
    return codes, near


def test_probing_finds_every_code_within_the_radius():
    codes, near = some_codes(1)
    index = ann.MultiIndex(codes)
    d = np.bitwise_count(codes[None] ^ near[:, None]).sum(2)
    needed = ann.radius_needed(codes[None], near[:, None])
    for radius in (0, 3, 7, 8, 13, 20, 40, 60):
        assert sum(f + 1 for f in ann.flips_allowed(radius, 8)) == radius + 1
        found = index.probe(near, radius)
        assert found[d <= radius].all()
        assert np.array_equal(found, needed <= radius)


def test_looking_up_probes_equals_running_through_buckets(monkeypatch):
    codes, near = some_codes(2, 60_000, 2)
    index = ann.MultiIndex(codes)
    assert len(index.parts[0][2]) > 8 * (1 + 16 + 120)  # up to two flips are looked up
    for radius in (0, 1, 3, 5, 9):
        assert np.array_equal(index.probe(near, radius), ann.radius_needed(codes[None], near[:, None]) <= radius)


def test_most_rows_are_not_probed():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:20]
    s = q @ x.T
    s[np.arange(20), np.arange(20)] = -1
    near = np.argsort(-s, axis=1)[:, :5]
    coder = ann.BinaryCoder(np.hstack([ann.learn_rotation(x[:4000], rng) for _ in range(8)]), 0)
    codes = coder.codes(x)
    coder.radius = ann.measured_radius(ann.radius_needed(codes[near], codes[:20, None]).ravel(), 0.985)
    block = ann.Block(np.arange(20_000), x, coder)
    qi, ids, _ = block.search(np.arange(20), q, 5)
    assert block.probed < 0.4 * 20 * 20_000  # independent directions are the hardest case
    assert sum(i in near[a] for a, i in zip(qi, ids, strict=True)) >= 98


def test_defined_results(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [math.nan, 1.0]), (200, [None, 1.0]), (250, [math.inf, 1.0]), (300, [1.0, 2.0, 3.0]), (1, [2.0, 0.0]), (2, [0.0, -1.0]), (2, [0.0, -1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(df, QUERY).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, None, round(math.sqrt(0.5), 9)), (0, 3, 2, 0.0), (0, 4, 2, 0.0)]
    assert ann.nearest(df.where("false"), QUERY).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), QUERY).count() == 0


def test_few_within_the_radius_falls_back_to_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "measured_radius", lambda *_: 0)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 32)).astype(np.float32)
    a = ann.nearest(frame(spark, np.arange(300), x), QUERY, rotations=1).collect()
    want = brute(np.arange(300), x.astype(np.float64))
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in a} == {(q, k, i) for q, v in want.items() for k, (i, _) in enumerate(v, 1)}


def test_one_row_repeated_often(spark):
    rows = [(7, [1.0, 2.0])] * 3000 + [(0, [1.0, 0.0]), (50, [0.5, 1.0]), (3, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, QUERY, block_rows=500).collect())
    assert got == [(0, k, 3 if k == 1 else 7) for k in range(1, 6)] + [(50, k, 3 if k == 1 else 7) for k in range(1, 6)]
