import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sketchloom.llm import simhash


def documents():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        t = "\n".join(prose(rng.randint(20, 40)) for _ in range(4))
        if i % 6 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 4 == 1:
            t += "\nLicensed under version 1." + str(i)
        rows.append([i, t, "en", f"s{i % 3}"])
        labels.append((i, int(i % 6 != 0), 0))
    bench = [(k, prose(30)) for k in range(3)]
    rows[11][1] += "\n" + bench[0][1]
    rows[13][1] += "\n" + bench[1][1] + "\n" + bench[2][1]
    for i, of in ((240, 1), (241, 1), (242, 2)):  # copies
        rows.append([i, rows[of][1], "en", "s1"])
    w = rows[3][1].split(" ")
    w[5] = "changed"
    rows.append([243, " ".join(w), "en", "s2"])  # a near copy
    rows += [[None, prose(50), "en", None], [250, None, None, "s0"], [251, "", "en", "s0"], [252, prose(9000), "en", "s1"]]
    return [(i, t, x, s, len(t or "")) for i, t, x, s in rows], labels, bench


def write(spark, tmp_path):
    docs, labels, bench = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_stages_and_run(spark, tmp_path):
    docs = write(spark, tmp_path)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns
        path = f"{tmp_path}/out-{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    bad = {i for i, *_ in docs if i is not None and i < 240 and i % 6 == 0}
    assert not bad & set(kept["quality"]) and {i for i, *_ in docs} - bad == set(kept["quality"])
    assert set(kept["lines"]) == set(kept["quality"])
    assert sum("Licensed under" in (t or "") for t in kept["lines"].values()) == 1
    # one of each group: copies of 1 and 2, the near copy of 3, and the empty ones
    texts = {i: t for i, t in kept["lines"].items() if i is not None}
    fp = {i: np.frombuffer(next(_fps(t)), np.uint8) for i, t in texts.items()}
    ids = sorted(texts)
    group = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 88:
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert set(kept["near_duplicates"]) - {None} == set(group.values())
    gone = set(kept["near_duplicates"]) - set(kept["decontamination"])
    assert gone == {11, 13}
    mix = {r["doc_id"]: r for r in cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()}
    assert set(mix) <= set(kept["decontamination"]) and all(r["taken"] == r["copies"] * r["size"] for r in mix.values())
    whole = {r["doc_id"]: r["taken"] for r in cp.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r["taken"] for i, r in mix.items()}


def _fps(text):
    h = simhash.shingle_hashes((text or "").encode(), 5)
    yield simhash.majority_bits(np.array(h, np.uint64), np.array([len(h)]), 8)[0].tobytes()


def test_near_copies_are_linked_by_fingerprints(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(400)]
        rows.append((2 * i, " ".join(w)))
        for _ in range(6):  # six changed words: about 30 of 396 shingles, similarity 0.86
            w[rng.randrange(400)] = "other"
        rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in cp.near_duplicate_stage(spark, df, "").select("doc_id").collect()}
    assert {2 * i for i in range(60)} <= left and len(left) <= 62


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
