import random

import pytest
from pyspark.sql import functions as F

from sketchloom.functions import bits

A, B = F.col, F.col


def words(bs, w):
    out = []
    for k in range(0, len(bs), w):
        x = sum(1 << i for i, b in enumerate(bs[k : k + w]) if b)
        out.append(x - (1 << 64) if w == 64 and x >> 63 else x)
    return out


def case(w, n_words, seed=0, rows=25):
    rng = random.Random(seed)
    for r in range(rows):
        a = [rng.random() < 0.5 for _ in range(w * n_words)]
        b = [rng.random() < 0.5 for _ in range(w * n_words)]
        if r == 0:
            a = [True] * len(a)
        lo = rng.randrange(0, len(a))
        yield r, a, b, rng.randrange(-2, len(a) + 4), lo, rng.randrange(0, len(a) + 3), rng.randrange(0, len(a) + 1)


@pytest.mark.parametrize("w,n", [(8, 10), (16, 3), (32, 2), (64, 3), (1, 20)])
def test_bits_match_lists(spark, w, n):
    rows = list(case(w, n))
    df = spark.createDataFrame([(r, words(a, w), words(b, w), i, lo, hi, cut) for r, a, b, i, lo, hi, cut in rows], "r int, a array<bigint>, b array<bigint>, i int, lo int, hi int, cut int")
    a, b, i = F.col("a"), F.col("b"), F.col("i")
    got = df.select(
        "r",
        bits.size_bits(a, w).alias("size"),
        bits.get_bit(a, i, w).alias("get"),
        bits.set_bit(a, i, True, w).alias("set"),
        bits.set_false(a, i, w).alias("unset"),
        bits.flip_bit(a, i, w).alias("flip"),
        bits.count_bits(a).alias("ones"),
        bits.count_bits_range(a, F.col("lo"), F.col("hi"), w).alias("range"),
        bits.count_bits_range_unchecked(a, 0, F.col("cut"), w).alias("left"),
        bits.count_bits_range_unchecked(a, F.col("cut"), w * n, w).alias("right"),
        bits.hamming(a, b).alias("dist"),
        bits.hamming_words("a", "b", n).alias("dist_words"),
        bits.bit_dot(a, b).alias("dot"),
        bits.or_code(a, b).alias("or"),
        bits.and_code(a, b).alias("and"),
        bits.xor_code(a, b).alias("xor"),
        bits.not_code(a, w).alias("not"),
        bits.to_bools(a, w).alias("bools"),
        bits.pack(bits.to_bools(a, w), w).alias("packed"),
        bits.repack(a, w, 8).alias("bytes"),
    ).collect()
    for (r, x, y, i, lo, hi, cut), g in zip(rows, sorted(got, key=lambda g: g["r"]), strict=True):
        size, inside = len(x), 0 <= i < len(x)
        put = lambda v: words(x[:i] + [v] + x[i + 1 :], w) if inside else words(x, w)  # noqa: B023, E731
        assert g["size"] == size and g["get"] == (x[i] if inside else None)
        assert g["set"] == put(True) and g["unset"] == put(False) and g["flip"] == (put(not x[i]) if inside else words(x, w))
        assert g["ones"] == sum(x) and g["range"] == (sum(x[lo:hi]) if lo < hi <= size else None)
        assert g["left"] + g["right"] == sum(x) and g["left"] == sum(x[:cut])
        assert g["dist"] == g["dist_words"] == sum(p != q for p, q in zip(x, y, strict=True)) and g["dot"] == sum(p and q for p, q in zip(x, y, strict=True))
        assert g["or"] == words([p or q for p, q in zip(x, y, strict=True)], w) and g["and"] == words([p and q for p, q in zip(x, y, strict=True)], w)
        assert g["xor"] == words([p != q for p, q in zip(x, y, strict=True)], w) and g["not"] == words([not p for p in x], w)
        assert g["bools"] == x and g["packed"] == words(x, w) and g["bytes"] == words(x + [False] * (-size % 8), 8)


def test_mixed_widths_and_lengths(spark):
    rng = random.Random(7)
    x, y = [rng.random() < 0.5 for _ in range(48)], [rng.random() < 0.5 for _ in range(32)]
    df = spark.createDataFrame([(words(x, 16), words(y, 32))], "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    g = df.select(
        bits.hamming_mixed(a, 16, b, 32).alias("dist"),
        bits.bit_dot_mixed(a, 16, b, 32).alias("dot"),
        bits.or_mixed(a, b, 16, 32, 8).alias("or"),
        bits.and_mixed(a, b, 16, 32, 64).alias("and"),
        bits.xor_mixed(b, a, 32, 16, 16).alias("xor"),
        bits.not_mixed(a, 16, 32).alias("not"),
        bits.hamming(a, F.slice(a, 1, 2)).alias("short"),
        bits.pack(F.array().cast("array<boolean>"), 8).alias("none"),
        bits.zeros(17, 16).alias("zeros"),
        bits.ones(17, 16).alias("ones"),
    ).first()
    both = list(zip(x, y, strict=False))
    assert g["dist"] == sum(p != q for p, q in both) and g["dot"] == sum(p and q for p, q in both)
    assert g["or"] == words([p or q for p, q in both] + [False] * 16, 8)
    assert g["and"] == words([p and q for p, q in both] + [False] * 16, 64)
    assert g["xor"] == words([p != q for p, q in both], 16)
    assert g["not"] == words([not p for p in x], 32) and g["short"] == 0 and g["none"] == []
    assert g["zeros"] == [0, 0] and g["ones"] == [65535, 65535]
