import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sketchloom.llm import graph, simhash


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    """doc index -> smallest index reachable"""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def some_texts(n=250):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 400))] for _ in range(n // 2)]
    texts = [" ".join(b) for b in base]
    for b in base:
        c = list(b)
        c[rng.randrange(len(c))] = "Edited"
        texts.append("\n ".join(c).upper())
    return texts + ["", None, " \t\n", "one", "ONE two", "long " * 30_000, texts[0], texts[0]]


def test_matches_brute_force(spark):
    texts = some_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r["id"]: r for r in simhash.near_duplicates(df).collect()}
    want = [brute_fingerprint(t) for t in texts]
    assert [int(got[i]["fp"].hex(), 16) for i in range(len(texts))] == want
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(want)


def test_small_tiles_lose_no_link(spark):
    rng = random.Random(5)
    texts = some_texts(60)
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df, radius=20, choose=1, tile=3).collect()}
    b = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df, radius=20, choose=1).collect()}
    assert a == b


def test_sliced_distances_match_popcounts():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 256, (128, 16), dtype=np.uint8)
    fp[1::2] = fp[::2]
    fp[1::2, 3] ^= rng.integers(0, 256, 64, dtype=np.uint8)
    planes, bits = simhash.bit_planes(fp), np.unpackbits(fp, axis=1)
    rows, blocks = np.repeat(np.arange(128), 2), np.tile([0, 1], 128)
    for radius in (0, 1, 2, 3, 7, 50):
        alive, word = simhash.sliced_within(planes, bits, rows, blocks, radius)
        full = np.zeros(256, np.uint64)
        full[alive] = word
        d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
        for p in range(256):
            want = sum(1 << j for j in range(64) if d[rows[p], blocks[p] * 64 + j] <= radius)
            assert int(full[p]) == want


def test_empty_nulls_and_ties(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, None), (3, "q r s t")], "doc_id long, text string")
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (3, 3)], key=repr)


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["a"]: r["b"] for r in graph.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(30)}}
    assert graph.connected_components(df.where(F.lit(False))).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [" \t".join("Abc"[: rng.randint(1, 3)] * rng.randint(1, 9) for _ in range(n)).encode() for n in (0, 1, 2, 3, 4, 50)] + [b"  x " * 9, b"y" * 40]
    for k in (1, 3, 5):
        whole = [simhash.shingle_hashes(t, k).tolist() for t in texts]
        for size in (1, 3, 10):
            monkeypatch.setattr(simhash, "_PIECE", size)
            assert [simhash.shingle_hashes(t, k).tolist() for t in texts] == whole
            monkeypatch.undo()
