import random
import re

import pyarrow as pa

from sketchloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, n=13):
    wins = []
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else []:
            wins.append((i, w[k : k + n]))
    out = []
    for i, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(1)
    vocab = ["the", "of", "é", "Ünder", "x1", "日本", "cat", "dog"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(12)] + [(50, "Cat? DOG!"), (51, None), (52, "..."), (None, "x1 x1 x1 x1"), (53, "Cat? DOG!"), (53, "the of")]
    docs = [(i, text(rng.randint(0, 60)) + ", " + (rng.choice(items)[1] or "") + "\n" + text(5)) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "!!"), (None, "cat dog"), (0, docs[0][1]), (103, "dog cat " * 20_000)], items


def test_matches_brute_force_in_one_shard_and_many(spark):
    docs, items = case()
    df = spark.createDataFrame([(i, t, 3, "y") for i, t in docs], "doc_id long, text string, n_words int, __n string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for shard in (1 << 20, 150):
        got = d.find_contamination(df, bench, keep=["doc_id"], shard_bytes=shard).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=repr) == want


def test_spans_point_into_the_original(spark):
    docs, items = case()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in d.find_contamination(df, bench, with_spans=True).collect():
        raw = (r["text"] or "").encode()
        covered = [w for s in r["spans"] for w in words(raw[s["start"] : s["end"]].decode())]
        all_ = words(r["text"])
        assert covered == [w for h in r["hit_words"] for w in all_[h["start"] : h["end"]]] and len(covered) == r["n_hit"]


def test_empty_tables(spark):
    docs, items = case()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.find_contamination(df.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in d.find_contamination(df, bench.where("false")).collect()} == {0}


def test_texts_and_items_in_pieces(monkeypatch):
    docs, items = case()
    items = [(str(i) if i is not None else None, t) for i, t in items] + [("long", " ".join(t or "" for _, t in items))]
    want = brute(docs, items)
    monkeypatch.setattr(d, "_PIECE", 40)
    monkeypatch.setattr(d, "_ITEM_WORDS", 7)
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in items], "text": [t for _, t in items]})
    parts = sorted({(r["id"], r["words"]) for b in d._items([batch], 13) for r in b.to_pylist()}, key=repr)
    assert sum(i == "long" for i, _ in parts) > 5
    rows = pa.RecordBatch.from_pydict({"i": [i for i, _ in docs], "t": [t for _, t in docs]})
    got = []
    for b in d._scan([rows], parts, 13, "t", False):
        for r in b.to_pylist():
            got.append((r["i"], r["__n"], sum(h["end"] - h["start"] for h in r["__hits"]), r["__items"]))
    assert sorted(got, key=repr) == want


def test_a_worker_holds_one_automaton():
    for k in range(3):
        d._windows([(None, f"a b c {k}")], 13)
    assert len(d._held) == 1
    many = d.Windows([("x", " ".join(f"w{i}" for i in range(3000)))], 13)  # two-digit word numbers
    found = list(many.scan([b"w17", b"no", *[f"w{i}".encode() for i in range(500, 514)], b"w600"]))
    assert [(a, b) for a, b, _ in found] == [(2, 15), (3, 16)]
