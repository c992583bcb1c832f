import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions import vectors
from sketchloom.operators import encode, index, knn, recall, sampling
from sketchloom.sources import vectors as source


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 12)).astype(np.float32)
    x[7] = x[5]
    c = rng.standard_normal((40, 12))
    bits = (x.astype(float) @ c.T >= 0).astype(np.uint8)
    d = source.from_numpy(spark, x).cache()
    codes = encode.encode(d, c, 16).cache()
    return d, codes, x.astype(float), bits, c


def want(score, k, largest):
    return {q: [(i, s[i]) for i in sorted(range(len(s)), key=lambda i: (-s[i] if largest else s[i], i))[:k]] for q, s in enumerate(score)}


def got(df, name):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["neighbor_id"], r[name]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def near(a, b):
    assert set(a) == set(b)
    for q in b:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]])


def test_encode_forms_agree(spark, world):
    d, codes, x, bits, c = world
    words = encode.pack_bits(bits, 16)
    assert dict((r["vec_id"], r["code"]) for r in codes.collect()) == {i: w.tolist() for i, w in enumerate(words)}
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "bit_idx int, center array<double>")
    assert sorted(map(tuple, encode.encode_join(d, centers, 16).collect())) == sorted(map(tuple, codes.collect()))
    few = d.select("vec_id", encode.encode_expr(F.col("embedding"), c[:9], 8).alias("code")).collect()
    assert {r["vec_id"]: r["code"] for r in few} == {i: w.tolist() for i, w in enumerate(encode.pack_bits(bits[:, :9], 8))}
    odd = spark.createDataFrame([(1, None), (2, [float("nan")] * 12), (3, [0.0] * 12)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["code"] for r in encode.encode(odd, c[:10], 8).collect()} == {1: None, 2: [0, 0], 3: [255, 3]}
    with pytest.raises(ValueError):
        encode.encode(d, np.zeros((0, 12)))


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_exact_search(world, method):
    d, codes, x, bits, _ = world
    q = d.where("vec_id < 30")
    near(got(knn.k_largest_dot(d, q, 7, method=method), "dot"), {k: v for k, v in want(x[:30] @ x.T, 7, True).items()})
    h = (bits[:30, None] != bits[None]).sum(2)
    near(got(knn.k_smallest_hamming(codes, codes.where("vec_id < 30"), 20, method=method), "dist"), want(h, 20, False))
    few = knn.k_largest_dot(d.where("vec_id < 4"), q.where("vec_id < 2"), 9, method=method)
    assert few.count() == 8


def test_many_query_blocks_agree(world):
    d, *_ = world
    from sketchloom.operators import topk

    a = got(knn.k_largest_dot(d, d.where("vec_id < 100"), 5), "dot")
    b = topk.scan_topk(d, "vec_id", "embedding", d.where("vec_id < 100"), "vec_id", "embedding", 5, knn._dots, knn._pair_dots, True, np.float64, "dot", "double", query_block=13)
    near(got(b, "dot"), a)


def test_refine_cascade_and_query(spark, world):
    d, codes, x, bits, c = world
    q, qc = d.where("vec_id < 20"), codes.where("vec_id < 20")
    one = encode.encode(d, c[:16], 16)
    h1 = (bits[:20, None, :16] != bits[None, :, :16]).sum(2)
    h = (bits[:20, None] != bits[None]).sum(2)
    first = want(h1, 60, False)
    second = {k: sorted(((i, s + h[k, i]) for i, s in v), key=lambda t: (t[1], t[0]))[:25] for k, v in first.items()}
    stages = [(one, one.where("vec_id < 20")), (codes, qc)]
    near(got(knn.cascade_hamming(stages, [60, 25]), "dist"), second)
    near(got(knn.cascade_hamming(stages[:1], [60]), "dist"), first)
    dots = x[:20] @ x.T
    best = lambda cand, k: {q: sorted(((i, dots[q, i]) for i, _ in v), key=lambda t: (-t[1], t[0]))[:k] for q, v in cand.items()}
    near(got(knn.query_cascade(d, [one, codes], q, [one.where("vec_id < 20"), qc], 5, [60, 25]), "dot"), best(second, 5))
    near(got(knn.query(d, codes, q, qc, 5, 600), "dot"), want(dots, 5, True))
    shuffled = spark.createDataFrame([(0, 9), (0, 3), (0, 500), (0, 3), (1, 2)], "query_id long, neighbor_id long")
    near(got(knn.refine_dot(d, q, shuffled, 2), "dot"), best({0: [(9, 0), (3, 0), (500, 0)], 1: [(2, 0)]}, 2))
    assert got(knn.refine_code(codes, qc, shuffled, 1), "dist")[0][0] == min(((i, h[0, i]) for i in (3, 9, 500)), key=lambda t: (t[1], t[0]))
    with pytest.raises(ValueError):
        knn.query(d, codes, q, qc, 5, 4)
    with pytest.raises(ValueError):
        knn.cascade_hamming(stages, [5])


def test_recall(spark, world):
    d, codes, x, bits, _ = world
    t = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 3)], "query_id long, neighbor_id long")
    p = spark.createDataFrame([(0, 2), (0, 2), (0, 9), (1, 1), (5, 3)], "query_id long, neighbor_id long")
    r = recall.recall(t, p).first()
    assert (r["hits"], r["n_true"], r["recall"]) == (2, 4, 0.5)
    q, qc = d.where("vec_id < 10"), codes.where("vec_id < 10")
    full = recall.recall_end_to_end(d, codes, q, qc, 10, 600).first()["recall"]
    some = recall.recall_end_to_end(d, codes, q, qc, 10, 100).first()["recall"]
    truth = want(x[:10] @ x.T, 10, True)
    found = want((bits[:10, None] != bits[None]).sum(2), 100, False)
    assert full == 1.0 and some == sum(len({i for i, _ in truth[k]} & {i for i, _ in found[k]}) for k in truth) / 100
    assert recall.recall_of_codes(codes, qc, knn.k_largest_dot(d, q, 10), 100).first()["recall"] == some
    assert recall.recall_of_predictions(d, q, knn.k_smallest_hamming(codes, qc, 100), 10).first()["recall"] == some


@pytest.mark.parametrize("layer,fanout", [(8, 2), (16, 4), (12, 3), (5, 10), (48, 5)])
def test_index_is_exact(spark, world, layer, fanout):
    _, codes, _, bits, _ = world
    full = np.vstack([bits, np.ones((1, 40), np.uint8)])
    table = codes.unionByName(spark.createDataFrame([(600, [65535, 65535, 255])], "vec_id long, code array<bigint>"))
    i = index.CodeIndex.build(table, layer, fanout, 48, 16)
    assert i.table.count() == 601 and i.height == -(-48 // layer)
    q = table.where("vec_id < 8 or vec_id = 600")
    h = {k: (full[k] != full).sum(1) for k in [*range(8), 600]}
    near(got(i.knn(q, 9), "dist"), {k: want([h[k]], 9, False)[0] for k in h})
    near(got(i.within(q, 12), "dist"), {k: [(j, s) for j, s in want([h[k]], 601, False)[0] if s <= 12] for k in h})
    assert i.node_counts().where("depth = 0").first()["n"] == 601
    assert i.knn(q, 1000).count() == 601 * 9


def test_index_arithmetic():
    assert index.n_nodes(256, 128, 8) == 73 and index.n_nodes(1024, 256, 4) == 341
    b = index.bucket_bounds(16, 4)
    assert b == sorted(b) and b[-1] == 16 and b[1] == 8
    for node in range(1, 60):
        p = index.parent_of(node, 3)
        assert index.child_of(p, index.child_index_of(node, 3), 3) == node and index.depth_of(node, 3) == index.depth_of(p, 3) + 1
    assert index.is_root(0) and index.is_leaf(5, 2, 3) and not index.is_leaf(3, 2, 3)
    with pytest.raises(ValueError):
        index.CodeIndex.build(None, 8, 11, 64)


def test_sampler_gives_each_id_once_an_epoch(world):
    d, *_ = world
    rows = sorted(map(tuple, sampling.draw(d, 0, 1500, seed=4).collect()))
    ids = [i for _, i in rows]
    assert [p for p, _ in rows] == list(range(1500))
    assert sorted(ids[:600]) == sorted(ids[600:1200]) == list(range(600)) and ids[:600] != ids[600:1200] and len(set(ids[1200:])) == 300
    assert sorted(map(tuple, sampling.draw(d, 500, 250, seed=4).collect())) == rows[500:750]
    assert sampling.draw(d.where("false"), 0, 5, 1).count() == 0


def test_kernels(spark):
    rng = np.random.default_rng(5)
    a, b, m = rng.standard_normal((3, 6)), rng.standard_normal((3, 6)), rng.standard_normal((6, 6))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    p, q = F.col("a"), F.col("b")
    cols = [vectors.dot(p, q), vectors.norm(p), vectors.induced_dist(p, q), vectors.cos_sim(p, q), vectors.rbf(1.5)(p, q), vectors.mahalanobis(m.tolist())(p, q), vectors.poly(0.3, 1.0, 2.0)(p, q), vectors.sigmoid(0.3, 0.1)(p, q), vectors.cosine_distance(p, q)]
    for r in df.select("i", *[c.alias(f"x{k}") for k, c in enumerate(cols)]).collect():
        x, y = a[r["i"]], b[r["i"]]
        cos = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
        assert np.allclose(r[1:], [x @ y, np.linalg.norm(x), np.linalg.norm(x - y), cos, np.exp(-((x - y) ** 2).sum() / 1.5), x @ m @ y, (0.3 * x @ y + 1) ** 2, np.tanh(0.3 * x @ y + 0.1), 1 - cos])
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.cos_sim(p, q), vectors.normalise(p), vectors.dot(F.array().cast("array<double>"), F.array().cast("array<double>"))).first()
    assert tuple(z) == (None, None, 0.0)
    w = vectors.zip_prods(df, df, "a", "b", "i").orderBy("i").collect()
    assert np.allclose([r["prod"] for r in w], (a * b).sum(1))
    assert vectors.cross_prods(df, df, "i", "i", "a", "b").count() == 9


def test_many_queries_are_streamed_past_blocks(spark):
    from sketchloom.operators import topk

    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 6))
    x[5:9] = x[4]
    d = source.from_numpy(spark, x).repartition(3)
    few = knn.k_largest_dot(d, d, 4).orderBy("query_id", "rank").collect()
    q = spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for rows in (1 << 18, 60):
        many = topk.scan_topk(d, "vec_id", "embedding", q, "vec_id", "embedding", 4, knn._dots, knn._pair_dots, True, np.float64, "dot", "double", query_block=50, block_rows=rows)
        assert many.orderBy("query_id", "rank").collect() == few
    assert len(few) == 2800


def test_leaf_scan_and_joins_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 8))
    codes = encode.encode(source.from_numpy(spark, x), rng.standard_normal((90, 8)), 128).repartition(4)
    built = index.CodeIndex.build(codes, 30, 5, 128, 128)
    asked = codes.where("vec_id % 50 = 3")
    results = []
    for most in (2048, 5):
        monkeypatch.setattr(index, "QUERY_BLOCK", most)
        results.append([[tuple(r) for r in df.orderBy("query_id", "rank").collect()] for df in (built.knn(asked, 7), built.within(asked, 12), built.knn(asked, 2000))])
    assert results[0] == results[1]
    brute = knn.k_smallest_hamming(codes, asked, 7).orderBy("query_id", "rank").collect()
    assert results[0][0] == [tuple(r) for r in brute] and len(results[0][2]) == 900 * 18
    cost = {r["query_id"]: r for r in built.knn_cost(asked, 7).collect()}
    assert len(cost) == 18 and all(7 <= r["distances"] <= 900 for r in cost.values())


def test_index_cost_counts_the_leaves_within_the_kth_distance(spark, monkeypatch):
    """A leaf that is nearest by its bound, but whose k codes are far from the query, does not widen what counts."""
    words = [0b11110000, *[0b00001111] * 3, *[0b00001110] * 3, *[0b11110001] * 2, 0, 255, 255]
    codes = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "vec_id long, code array<bigint>")
    built = index.CodeIndex.build(codes, 8, 4, 8, 8)
    bound, bits_of = index.bucket_bounds(8, 4), [bin(w).count("1") for w in words]
    leaf = [sum(n >= b for b in bound[:-1]) for n in bits_of]
    span = [(a, b - 1) for a, b in zip([0, *bound[:-1]], [*bound[:-1], 9], strict=True)]

    def cost(q, k):
        kth = sorted(bin(words[q] ^ w).count("1") for w in words)[:k][-1]
        seen = {x for x in leaf if max(span[x][0] - bits_of[q], bits_of[q] - span[x][1], 0) <= kth}
        return len(seen), sum(x in seen for x in leaf)

    for most in (2048, 2):
        monkeypatch.setattr(index, "QUERY_BLOCK", most)
        for k in (1, 2, 3, 5, 12, 20):
            got = {r["query_id"]: (r["leaves"], r["distances"]) for r in built.knn_cost(codes, k).collect()}
            assert got == {q: cost(q, k) for q in range(len(words))}, (most, k)


@pytest.mark.parametrize("word_bits", [32, 64, 128])
def test_hamming_distances_with_the_highest_bit_set(spark, word_bits):
    rng = np.random.default_rng(9)
    x, c = rng.standard_normal((300, 7)), rng.standard_normal((128, 7))
    codes = encode.encode(source.from_numpy(spark, x), c, word_bits)
    bit = x @ c.T >= 0
    d = (bit[:, None] != bit[None]).sum(2)
    want = {(q, r + 1, i, d[q, i]) for q in (0, 50) for r, i in enumerate(sorted(range(300), key=lambda i: (d[q, i], i))[:9])}
    for method in ("arrow", "sql"):
        assert {tuple(r) for r in knn.k_smallest_hamming(codes, codes.where("vec_id in (0, 50)"), 9, method=method).collect()} == want


def test_draws_rank_only_the_buckets_they_need(spark, monkeypatch):
    d = spark.range(1000).selectExpr("id as vec_id")
    whole = {r["draw"]: r["vec_id"] for r in sampling.draw(d, 0, 2300, seed=5).collect()}
    assert sorted(whole) == list(range(2300)) and all(sorted(whole[e * 1000 + i] for i in range(1000)) == list(range(1000)) for e in (0, 1))
    monkeypatch.setattr(sampling, "bucket_bits", lambda n: 6)
    assert {r["draw"]: r["vec_id"] for r in sampling.draw(d, 0, 2300, seed=5).collect()} == whole
    some = sampling.draw(d, 990, 25, seed=5)
    assert {r["draw"]: r["vec_id"] for r in some.collect()} == {i: whole[i] for i in range(990, 1015)}
    assert "shiftrightunsigned" in some._jdf.queryExecution().toString()
    assert sampling.draw(d.where("false"), 0, 5, seed=5).count() == 0
