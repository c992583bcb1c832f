import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import quality
from sketchloom.llm.common import held_out


def features(texts):
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return [f.copy() for f in quality.document_features(np.frombuffer(b"".join(raw), np.uint8), off)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        kind = i % 5
        if kind == 0:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x for x in w[:10] for _ in range(12)]
        out.append((i, " ".join(w), int(kind != 0)))
    return out


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two.", "", None, "x", "one ONE 12 *** é\n\tlast!!", "a" * 50, " ", "One two two."]
    together = features(texts)
    for t, f in zip(texts, together, strict=True):
        assert f.tolist() == features([t])[0].tolist() == sorted(set(f.tolist()))
    assert together[0].tolist() == together[-1].tolist() and not len(together[1]) and not len(together[6])


def test_log_count_ratios_and_separation():
    rows = corpus(400)
    f, y = features([t for _, t, _ in rows]), np.array([q for _, _, q in rows], float)
    m = quality.fit(f[:300], y[:300])
    s = np.array([m.score(x) for x in f[300:]])
    assert ((s >= 0.5) == (y[300:] > 0)).mean() > 0.97
    assert 0 <= m.score(np.zeros(0, int)) <= 1


def test_scores_equal_a_brute_force_nbsvm():
    """Ratios counted in dictionaries, the dual solved by projected gradient over the whole Gram matrix."""
    rows = corpus(120, seed=3)
    texts, y = features([t for _, t, _ in rows]), np.array([q for _, _, q in rows], float)
    m = quality.fit(texts, y, epochs=3000)
    aside = np.random.default_rng(5).random(len(texts)) < 0.2
    train = [i for i in range(len(texts)) if not aside[i]]
    counts = {1: {}, 0: {}}
    for i in train:
        for f in texts[i].tolist():
            counts[int(y[i])][f] = counts[int(y[i])].get(f, 0) + 1
    total = {c: sum(int(y[i]) == c for i in train) + 2.0 for c in (0, 1)}
    ratio = {}
    for f in {*counts[0], *counts[1]}:
        a, b = counts[1].get(f, 0), counts[0].get(f, 0)
        if a + b >= 2:
            ratio[f] = np.log((a + 1) / total[1]) - np.log((b + 1) / total[0])
    vectors = []
    for t in texts:
        v = {f: ratio[f] for f in t.tolist() if ratio.get(f)}
        size = np.sqrt(sum(x * x for x in v.values()))
        vectors.append({f: x / size for f, x in v.items()})
    dot = lambda a, b: sum(x * b.get(f, 0.0) for f, x in a.items()) + 1.0  # noqa: E731 (1: the bias)
    sign = np.where(y[train] > 0, 1.0, -1.0)
    q = np.array([[dot(vectors[i], vectors[j]) for j in train] for i in train]) * sign[:, None] * sign[None, :]
    alpha, step = np.zeros(len(train)), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(200_000):
        new = np.clip(alpha - step * (q @ alpha - 1), 0, 1)
        if np.abs(new - alpha).max() < 1e-10:
            break
        alpha = new
    margin = [sum(a * s * dot(vectors[i], v) for a, s, i in zip(alpha, sign, train, strict=True)) for v in vectors]
    got = [m.margin(t) for t in texts]
    assert np.abs(np.array(got) - margin).max() < 2e-3
    assert [m.score(t) for t in texts] == pytest.approx([1 / (1 + np.exp(-(m.slope * x + m.shift))) for x in margin], abs=2e-3)


def test_whole_words_and_pairs_count():
    a, b = features(["internatAAAAAAAAionalize", "internatbbbbbbbbionalize"])
    word = lambda f: set(f[(f >= quality.WORDS) & (f < quality.PAIRS)].tolist())
    assert word(a) and not word(a) & word(b)
    long = "y" * 400
    a, b = features([long + "x" + long, long + "z" + long])
    assert not word(a) & word(b)
    a, b = features(["one two three", "two one three"])
    assert word(a) == word(b) and set(a[a >= quality.PAIRS]) != set(b[b >= quality.PAIRS])


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc.", "dd!", "12", "é" * 9, "x" * 300]) for _ in range(n)) + " " * (n % 3) for n in (3, 40, 41, 42, 400)]
    texts += ["word " * 30, "z" * 500, " " * 200, "end a", "  lead"]
    want = [features([t])[0].tolist() for t in texts]
    monkeypatch.setattr(quality, "_PIECE", 4)
    for words in (1, 2, 7):
        monkeypatch.setattr(quality, "_PIECE_WORDS", words)
        assert [features([t])[0].tolist() for t in texts] == want


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    raw = np.frombuffer(b"some words of a very long text, 1234 and more. " * 400_000, np.uint8)  # 19 MB
    tracemalloc.start()
    f = next(quality.document_features(raw, np.array([0, len(raw)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(f) and peak < 15 * len(raw)


def test_held_out_labels_are_never_read(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", None), (None, "null id", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (None, 1), (3, 0)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.train_quality(docs, labels, ~held_out("id"))
    b = quality.train_quality(docs, turned, ~held_out("id"))
    assert np.array_equal(a.weight, b.weight) and a.slope == b.slope
    got = quality.score_quality(docs, a).toPandas()
    assert list(got.columns) == ["doc_id", "text", "score", "score_", "predicted"] and len(got) == 304
    assert got.score_.between(0, 1).all() and (got.predicted == (got.score_ >= 0.5)).all()
    truth = {i: q for i, _, q in rows}
    known = got[got.doc_id.isin(truth)]
    assert (known.predicted == known.doc_id.map(truth)).mean() > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(i, "some text") for i in range(5)], "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    m = quality.train_quality(docs, told, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, m).collect())
    assert quality.score_quality(docs.where("false"), m).count() == 0
