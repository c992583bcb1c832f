"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios (NBSVM).

N-grams are taken over whole texts, each stream hashed into 2**16 features of its own:

* 4-grams of character classes (letters, capitals and digits folded; other ASCII characters as they are),
* 3-grams of characters (A-Z lowered, UTF-8 bytes),
* 1- to 3-grams of word shapes (capitals, digits, end mark, length, whether the word repeats the one before),
* words and pairs of words, by a hash of all their bytes.

A feature counts once per document; its value is the log ratio of its smoothed shares in the two classes, and rows have
unit length. The dual coordinate descent solver runs on the driver over a bounded sample of labelled rows (`max_train`,
chosen by a hash of the id, and where many rows share an id of the text too), of which a fifth calibrates the margin to
a probability.

Defined results: null and empty texts have no features and get the calibrated score of the bias; rows without a label,
or of the held-out fold, are scored and never learned from; repeated rows score alike and are learned from once; of
repeated labels the largest counts, and ties of scores are left as they are; without labels of both classes every score
is the smoothed share of label 1 (0.5 if there are none); an empty table gives an empty result; a very long text is
read whole, in pieces; columns named like the added ones are kept, and the added ones get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_free, materialize, text_slices, token_hashes, words_of

STREAM_BITS = 16
_D = 1 << STREAM_BITS
#: Where each stream's features begin.
CLASSES, CHARACTERS, SHAPES, WORDS, PAIRS = (i * _D for i in range(5))
DIMENSIONS = 5 * _D
#: A longer text is read in pieces of so many bytes, and of so many words.
_PIECE, _PIECE_WORDS = 1_000_000, 100_000


def _classes() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    c[ord("a") : ord("z") + 1] = ord("a")
    c[ord("A") : ord("Z") + 1] = ord("A")
    c[ord("0") : ord("9") + 1] = ord("0")
    c[9:14] = ord(" ")
    c[ord("\n")] = ord("\n")
    c[128:] = ord("a")
    return c


_CLASS = _classes().astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_PLAIN = _DIGIT | (_CLASS == ord("a")) | _UPPER


def _fold(h: np.ndarray) -> np.ndarray:
    """64-bit values to 16 bits by multiplicative hashing."""
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - STREAM_BITS)).astype(np.int32)


def _grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n-grams of byte symbols, by the position where they start."""
    if len(symbols) < n:
        return np.zeros(0, np.int32)
    h = symbols[: len(symbols) - n + 1].astype(np.uint64)
    for k in range(1, n):
        h = h << np.uint64(8) | symbols[k : len(symbols) - n + 1 + k]
    return _fold(h)


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(where its stream begins, how many more words it takes, number at each word) of each kind of word feature.

    opens: whether a word is the first of its text.
    """
    if not len(starts):
        return []
    spans = np.stack([starts, ends], 1).ravel()
    within = lambda flags: np.add.reduceat(np.append(flags[raw], False), spans, dtype=np.int32)[::2]
    size, upper, digit, plain = ends - starts, within(_UPPER), within(_DIGIT), within(_PLAIN)
    word = token_hashes(raw, starts, ends)
    again = np.concatenate([[False], word[1:] == word[:-1]]) & ~opens
    caps = np.where(upper == 0, 0, np.where((upper == plain - digit) & (upper > 1), 2, np.where((upper == 1) & _UPPER[raw[starts]], 1, 3)))
    last = raw[ends - 1]
    mark = np.where(_PLAIN[last], 0, np.where((last == 46) | (last == 44), 1, np.where((last == 33) | (last == 63), 2, 3)))
    long_ = np.searchsorted([3, 8, 16], size)
    shape = (caps | (digit > 0) << 2 | mark << 3 | (plain == 0) << 5 | again << 6 | long_ << 7 | 1 << 9).astype(np.uint64)
    two, three, pair = shape.copy(), np.zeros(len(shape), np.uint64), np.zeros(len(shape), np.uint64)
    two[:-1] = shape[:-1] << np.uint64(10) | shape[1:]
    three[:-2] = two[:-2] << np.uint64(10) | shape[2:]
    pair[:-1] = word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:]
    return [(SHAPES, 0, _fold(shape)), (SHAPES, 1, _fold(two)), (SHAPES, 2, _fold(three)), (WORDS, 0, _fold(word)), (PAIRS, 1, _fold(pair))]


def document_features(raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted feature numbers of each document of a run of texts, each number once."""
    seen = np.zeros(DIMENSIONS, bool)
    if len(off) == 2 and len(raw) > _PIECE:
        _mark_long(raw, seen)
        yield np.flatnonzero(seen)
        return
    classes, characters = _grams(_CLASS[raw], 4), _grams(_LOWER[raw], 3)
    starts, ends = words_of(raw, off)
    word_off = np.searchsorted(starts, off)
    opens = np.zeros(len(starts) + 1, bool)
    opens[word_off[:-1]] = True
    streams = _words(raw, starts, ends, opens[:-1])
    for d in range(len(off) - 1):
        a, b, u, v = off[d], off[d + 1], word_off[d], word_off[d + 1]
        seen[CLASSES + classes[a : max(a, b - 3)]] = True
        seen[CHARACTERS + characters[a : max(a, b - 2)]] = True
        for begin, more, number in streams:
            seen[begin + number[u : max(u, v - more)]] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        yield out


def _mark_long(raw: np.ndarray, seen: np.ndarray) -> None:
    """The features of one text, in pieces that share what the n-grams across their edges need."""
    for a in range(0, len(raw), _PIECE):
        seen[CLASSES + _grams(_CLASS[raw[a : a + _PIECE + 3]], 4)] = True
        seen[CHARACTERS + _grams(_LOWER[raw[a : a + _PIECE + 2]], 3)] = True
    starts, ends = words_of(raw, np.array([0, len(raw)]))
    for u in range(0, len(starts), _PIECE_WORDS):
        v = min(u + _PIECE_WORDS, len(starts))
        lo, hi = max(0, u - 1), min(v + 2, len(starts))  # the word before tells repeats; pairs and triples reach on
        at = starts[lo]
        for begin, more, number in _words(raw[at : ends[hi - 1]], starts[lo:hi] - at, ends[lo:hi] - at, np.arange(lo, hi) == 0):
            seen[begin + number[u - lo : max(u, min(v, hi - more)) - lo]] = True


@dataclass
class NBSVM:
    """Weights over features (bias apart) and the two numbers that turn a margin into a probability."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        r = self.ratio[features]
        norm = float(np.sqrt(np.dot(r, r)))
        return float(np.dot(self.weight[features], r)) / norm + self.bias if norm > 0 else self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -35, 35))))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 5) -> NBSVM:
    """Log-count ratios, then dual coordinate descent on the hinge loss, then a sigmoid on rows kept aside."""
    y = np.where(labels > 0, 1.0, -1.0)
    zero = np.zeros(DIMENSIONS, np.float32)
    if len(set(y.tolist())) < 2:
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return NBSVM(zero, zero, 0.0, 0.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    aside = rng.random(len(rows)) < 0.2
    if len({*y[~aside].tolist()}) < 2 or len({*y[aside].tolist()}) < 2:
        aside[:] = False
    train = np.flatnonzero(~aside)
    counts = {s: np.bincount(np.concatenate([rows[i] for i in train if y[i] == s]), minlength=DIMENSIONS) + 1.0 for s in (1.0, -1.0)}
    total = {s: (y[train] == s).sum() + 2.0 for s in counts}
    ratio = np.log((counts[1.0] / total[1.0]) / (counts[-1.0] / total[-1.0])).astype(np.float32)
    ratio[counts[1.0] + counts[-1.0] <= 3] = 0  # seen in one training document at most: says nothing about others
    values = {}
    for i in train:
        r = ratio[rows[i]].astype(np.float64)
        norm = np.sqrt(np.dot(r, r))
        values[i] = (r / norm if norm > 0 else r).astype(np.float32)
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(train):
            f, x = rows[i], values[i]
            g = y[i] * (np.dot(w[f], x) + bias) - 1
            new = min(max(alpha[i] - g / (np.dot(x, x) + 1), 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    model = NBSVM(ratio, w.astype(np.float32), float(bias), 1.0, 0.0)
    some = np.flatnonzero(aside) if aside.any() else train
    m = np.array([model.margin(rows[i]) for i in some])
    good = (y[some] > 0).astype(float)
    want = np.where(good > 0, (good.sum() + 1) / (good.sum() + 2), 1 / (len(good) - good.sum() + 2))  # Platt's targets
    a, b = 2.0, 0.0
    for _ in range(100):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        e, v = p - want, p * (1 - p) + 1e-12
        h = np.array([[np.dot(v, m * m) + 1e-3, np.dot(v, m)], [np.dot(v, m), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [np.dot(e, m) + 1e-3 * (a - 2.0), e.sum()])
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 6000, seed: int = 5) -> NBSVM:
    """Fit on about `max_train` labelled rows, chosen by a hash of the id among those for which `learn` holds.

    `learn` is a condition on a column named `id`. Repeated labels of an id count as their largest; null labels are
    left out.
    """
    told = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    share = min(1.0, max_train / max(1, told.where(learn).count()))
    # about max_train ids, written out: the join is planned by the size that they have
    told = materialize(told.where(learn & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))))
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(told, "id")
    rows = max(1, base.select("id").count())
    if rows > 2 * max_train:  # ids that many rows share: of those rows too, some are chosen by a hash
        base = base.where(F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.lit(1 << 30)) < int(2 * max_train / rows * (1 << 30)))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch, "t", 500_000):
                f = [x.astype(np.int32).tobytes() for x in document_features(raw, off)]
                yield pa.RecordBatch.from_pydict({"id": part.column("id").cast(pa.string()), "y": part.column("y").cast(pa.int32()), "f": pa.array(f, pa.binary())})

    some = base.mapInArrow(featurise, "id string, y int, f binary").groupBy("id", "y", "f").count()  # repeated rows once
    got = some.select("id", "y", "f").toArrow().sort_by([("id", "ascending"), ("f", "ascending")])
    return fit([np.frombuffer(f.as_py(), np.int32) for f in got["f"]], np.array(got["y"].to_pylist(), float), seed=seed)


def score_quality(docs: DataFrame, model: NBSVM, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns `keep` (default: all) plus score and predicted (names get an underscore if taken)."""
    keep = docs.columns if keep is None else keep
    score, predicted = first_free(keep, "score"), first_free(keep, "predicted")
    base = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    schema = T.StructType([f for f in base.schema.fields if f.name != "t"] + [T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch, "t", 500_000):
                s = [model.score(f) for f in document_features(raw, off)]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names if c != "t"} | {"s": pa.array(s, pa.float64())})

    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("s").alias(score), (F.col("s") >= threshold).cast("int").alias(predicted))
