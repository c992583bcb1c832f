import hashlib
import random

import numpy as np
import pytest

from sketchloom.llm import suffix


def brute(texts, width):
    where = {}
    raws = [(t or "").encode() for t in texts]
    for d, r in enumerate(raws):
        for i in range(len(r) - width + 1):
            where.setdefault(r[i : i + width], []).append((d, i))
    gone = [bytearray(len(r)) for r in raws]
    for spots in where.values():
        if len(spots) > 1:
            for d, i in spots:
                gone[d][i : i + width] = b"\x01" * width
    out = []
    for r, g in zip(raws, gone, strict=True):
        kept = bytes(x for x, y in zip(r, g, strict=True) if not y)
        spans = sum(1 for i, y in enumerate(g) if y and not (i and g[i - 1]))
        out.append((len(r), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def some_texts(width, seed=1):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [prose(rng.randint(width // 2, 4 * width)) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [prose(rng.randint(0, 3 * width)), rng.choice(shared)[rng.randint(0, 20) :]]
        texts.append("".join(parts))
    t = list(texts[3] + shared[0])
    for _ in range(5):
        t[rng.randrange(len(t))] = "Z"
    return [*texts, "".join(t), texts[5], texts[5], None, "", "x" * (width - 1), "x" * width, "ab" * (3 * width), "Hahe " * width, "é" * width, shared[1][:width], prose(width - 1) + shared[2][:width]]


@pytest.mark.parametrize("width,kgram", [(200, 48), (20, 8), (5, 5), (3, 1)])
def test_matches_brute_force(spark, width, kgram):
    texts = some_texts(width)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(5)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, width=width, kgram=kgram).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, width)


@pytest.mark.parametrize("hot", [0, 900])
def test_hot_groups_are_cut_again(spark, hot):
    texts = some_texts(60, seed=3)
    phrase = "the same phrase is here"
    rng = random.Random(8)
    texts += ["".join(rng.choice("xyz") for _ in range(90)) + phrase + "".join(rng.choice("uvw") for _ in range(rng.randint(20, 90))) for _ in range(30)]
    texts += [t[60:] + "!" for t in texts[-6:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, width=60, kgram=12, hot_bytes=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 60)


def test_order_of_suffixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 7, 50, 400):
        for letters in (1, 2, 26):
            t = rng.integers(1, letters + 1, n)
            r = suffix.ranks(t, 1, 10**9)
            assert np.argsort(r).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_wide_symbols_pack_in_two_steps():
    rng = np.random.default_rng(2)
    t = rng.integers(1, 4, 600) * (1 << 29)
    assert np.argsort(suffix.ranks(t, 1, 10**9)).tolist() == sorted(range(600), key=lambda i: t[i:].tolist())


def test_prefix_order_when_recursion_ends_early():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 99, 300, dtype=np.uint8)) * 4 + bytes(rng.integers(97, 100, 500, dtype=np.uint8))
    for width in (1, 4, 9, 30, 200):
        starts = np.arange(len(data) - width + 1)
        seen = {}
        for i in starts:
            seen.setdefault(data[i : i + width], []).append(i)
        assert suffix.repeated_starts(data, starts, width).tolist() == [len(seen[data[i : i + width]]) > 1 for i in starts]


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(9000)), None]
    texts[1] = "q" * 50 + texts[0][4000:4700] + "r" * 30
    want = brute(texts, 200)
    whole = {(h, a) for h, _, a, _ in zip(*suffix.anchor_ranges(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, 9000]), 200, 48), strict=True)}
    assert len(whole) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df).collect()}
    assert [got[0], got[1]] == want
    monkeypatch.setattr(suffix, "_PIECE", 1000)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"e": [b"7"], "t": [texts[0]]})
    pieces = {(h, a + i) for b in suffix._anchors([batch], 200, 48) for h, a, n in zip(b["h"].to_pylist(), b["at"].to_pylist(), b["more"].to_pylist(), strict=True) for i in range(n + 1)}
    full = {(h, a + i) for h, _, a, n in zip(*suffix.anchor_ranges(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, 9000]), 200, 48), strict=True) for i in range(n + 1)}
    assert pieces == full


def test_kept_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "-"), (None, "b"), (2, "zz")], "doc_id long, text string")
    got = {r["id"]: bytes(r["kept"]) for r in suffix.remove_repeats(df, width=4, kgram=2, with_text=True).collect()}
    assert got == {1: b"-", None: b"b", 2: b"zz"}
    assert suffix.remove_repeats(df.where("false")).count() == 0


def periodic(rng, width):
    unit = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    out = []
    for n in (1, 2, 3, 7, width // 4, width // 2, width - 1, width, width + 1):
        u = unit(n)
        run = u * (4 * width // n + 2)
        out += [unit(30) + run[: rng.randint(width, len(run))] + unit(40), run[n // 2 :][: width + rng.randint(0, n)], unit(9) + run[1:][: width] + "!"]
        out.append(run[: 2 * width] + unit(3) + run[: 2 * width])
    return [*out, "a" * (3 * width) + "b" * (3 * width), "ab" * width + "a" * width, "é" * (2 * width), "x" * width, "x" * (width - 1), "y" * (width + 1)]


@pytest.mark.parametrize("width,kgram", [(40, 10), (60, 48), (8, 3), (5, 1)])
def test_periodic_texts_match_brute_force(spark, width, kgram):
    texts = periodic(random.Random(width), width)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, width=width, kgram=kgram).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, width)


def test_periodic_runs_have_few_anchors(spark):
    for unit in (b"a", b"ab", b"abcdefghi", b"some phrase of words, "):
        raw = np.frombuffer(unit * (300_000 // len(unit)), np.uint8)
        spans = []
        h, _, _, more = suffix.anchor_ranges(raw, np.array([0, len(raw)]), 200, 48, spans)
        assert (more + 1).sum() == len(unit) and spans == [(0, 0, len(raw))]
    texts = ["a" * 5_000_000, "b" + "a" * 200 + "c", "a" * 199]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["n_removed"] for r in suffix.remove_repeats(df).collect()}
    assert got == {0: 5_000_000, 1: 200, 2: 0}
