import random

import numpy as np
from pyspark.sql import functions as F

from sketchloom.llm import langid
from sketchloom.llm.common import held_out

PARTS = {"aa": ["the", "ing", "tion", "and"], "bb": ["ung", "sch", "ein", "keit"], "cc": ["eau", "é", "ment", "oir"]}


def corpus(n):
    rng = random.Random(4)
    langs = sorted(PARTS)
    return [(i, " ".join("".join(rng.choice(PARTS[langs[i % 3]]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), langs[i % 3]) for i in range(n)]


def test_learns_and_never_reads_held_out_labels(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, x, 1.0) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    turned = docs.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (langid.train_language(d, ~held_out()) for d in (docs, turned))
    assert a.labels == b.labels == ["aa", "bb", "cc"] and np.array_equal(a.weight, b.weight) and a.temperature == b.temperature
    got = langid.predict_language(docs, a).withColumn("held_out", held_out()).toPandas()
    assert "score_" in got and (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97
    assert got.score_.between(0, 1).all()


def test_defined_results(spark):
    rows = [*corpus(60), (100, None, "aa"), (101, "", "aa"), (102, "12 34 !!", "bb"), (103, "the " * 40_000, None), (None, "sch ein", "bb"), (3, corpus(4)[3][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train_language(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict_language(docs, m).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))
    assert got[103]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb"
    none = langid.train_language(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict_language(docs, none).collect()} == {"und"}
    one = langid.train_language(docs.where("lang = 'aa'"), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict_language(docs.where("doc_id = 0"), one).collect()} == {("aa", 1.0)}
    assert langid.predict_language(docs.where("false"), m).count() == 0


def test_idf_is_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, "abc" if i < 7 else "xyz", "aa") for i in range(10)], "doc_id long, text string, lang string")
    got = {}
    for r in docs.select(F.col("text").alias("t")).repartition(3).mapInArrow(langid._counts, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        got[r["f"]] = r["n"]
    assert got[-1] == 10 and got[int(next(langid.gram_numbers("a"))[0])] == 7 and got[int([*langid.gram_numbers("xyz")][2][0])] == 3


def test_penalty_gives_exact_zeros_and_temperature_helps():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(300):
        y = rng.integers(2)
        f = np.unique(np.concatenate([rng.integers(100, 4000, 30), [int(y)] if rng.random() < 0.8 else [1 - int(y)]]))
        rows.append((f, np.full(len(f), 1 / len(f))))
        labels.append("ab"[y])
    m = langid.fit(rows, labels, np.ones(langid.DIMENSIONS, np.float32), l1=0.5)
    used = np.unique(np.concatenate([f for f, _ in rows]))
    assert (m.weight[used] == 0).all(axis=1).mean() > 0.3 and np.abs(m.weight[:2]).min() > 0
    assert m.temperature > 0


def test_weights_equal_a_brute_force_ftrl():
    """One coordinate at a time, in dictionaries, in the same order of rows."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(60):
        y = int(rng.integers(3))
        f = np.unique(np.concatenate([rng.integers(50, 400, 15), [y]]))
        rows.append((f, rng.random(len(f)).astype(np.float32)))
        labels.append("abc"[y])
    weights = (rng.random(langid.DIMENSIONS) + 0.5).astype(np.float32)
    m = langid.fit(rows, labels, weights, epochs=2)
    order = np.random.default_rng(3)
    aside = order.random(60) < 0.2
    z, n = {}, {}

    def weight(f, c):
        l1, l2 = (0.0, 0.0) if f == "bias" else (0.02, 0.02)
        zi = z.get((f, c), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(n.get((f, c), 0.0))) / 0.5 + l2)

    xs = [{**{int(f): float(np.float32(v * weights[f] * 20.0)) for f, v in zip(*r, strict=True)}, "bias": 1.0} for r in rows]
    for _ in range(2):
        for i in order.permutation(np.flatnonzero(~aside)):
            w = {(f, c): weight(f, c) for f in xs[i] for c in "abc"}
            s = {c: sum(x * w[f, c] for f, x in xs[i].items()) for c in "abc"}
            top = max(s.values())
            total = sum(np.exp(v - top) for v in s.values())
            for c in "abc":
                error = np.exp(s[c] - top) / total - (labels[i] == c)
                for f, x in xs[i].items():
                    g = error * x
                    before = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / 0.5 * w[f, c]
                    n[f, c] = before + g * g
    for k, c in enumerate("abc"):
        assert abs(m.bias[k] - weight("bias", c)) < 1e-6
        for f in range(400):
            assert abs(m.weight[f, k] - weight(f, c) * weights[f]) < 1e-5
    held = [sum(x * np.array([weight(f, c) for c in "abc"]) for f, x in xs[i].items()) for i in np.flatnonzero(aside)]
    told = ["abc".index(labels[i]) for i in np.flatnonzero(aside)]
    loss = lambda t: np.mean([np.log(np.exp(s / t).sum()) - s[y] / t for s, y in zip(held, told, strict=True)])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4000))
    assert abs(np.log(m.temperature / grid[np.argmin([loss(t) for t in grid])])) < 0.01


def test_long_texts_in_pieces(monkeypatch):
    texts = ["\u03a3\u03a3 abc \u03a3", "ab", "a", "", "the quick brown fox", "x" * 23]
    counts = [langid.gram_counts(t) for t in texts]
    rng = np.random.default_rng(1)
    m = langid.LanguageModel(["a", "b"], rng.random((langid.DIMENSIONS, 2)).astype(np.float32), np.zeros(2), 1.0)
    logits = [m.logits(t) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_PIECE", size)
        for t, n, z in zip(texts, counts, logits, strict=True):
            assert np.array_equal(langid.gram_counts(t), n) and np.allclose(m.logits(t), z, rtol=1e-12)


def test_repeated_rows_are_learned_once(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    twice = docs.unionByName(docs.where("doc_id = 4"))
    used = []
    keep = langid.fit
    try:
        langid.fit = lambda r, y, w, **k: used.append(len(r)) or keep(r, y, w, **k)
        langid.train_language(docs, F.lit(True))
        langid.train_language(twice, F.lit(True))
    finally:
        langid.fit = keep
    assert used == [60, 60]
