"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased code points give 1- to 3-grams, hashed into 2**17 features. Term frequency is a text's share of an n-gram
among all of its n-grams, so a text's logits are means over its n-gram positions and whole texts are scored with
gathers and segment sums. Document frequencies are counted over every document that may be learned from; weights are
fitted by follow-the-regularised-leader (per-coordinate rates, elastic-net penalties) on a bounded sample of them
(`max_train`), and one temperature is then fitted to a fifth of that sample kept aside.

Long texts are read whole, in pieces that overlap by two characters: counts and sums of pieces add up exactly.

Defined results: a text that is null or has no letter is `und` with score 0; null labels are never learned from;
repeated rows predict alike and count once in the fitted sample (in the document frequencies they count each time); if
there is no label to learn from everything is `und` with score 0, and with a single label that label has score 1; an
empty table gives an empty result; ties go to the label first in order; columns named like the added ones are kept, and
the added ones get an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_free

BITS = 17
DIMENSIONS = 1 << BITS
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SCALE = 20.0  # brings mean TF-IDF values to the order of 1
_KEYS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


#: Characters that are turned into n-grams at once.
_PIECE = 250_000


def gram_numbers(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams of a text, one per position, in pieces of the text."""
    low = text.lower()  # as a whole, since the end of a word can matter
    for a in range(0, len(low), _PIECE):
        c = np.frombuffer(low[a : a + _PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(_PIECE, len(low) - a)
        h = np.zeros(len(c), np.uint32)
        for n, key in enumerate(_KEYS):
            h = (h[: max(0, len(c) - n)] ^ c[n:]) * key  # wraps
            h ^= h >> np.uint32(15)
            yield (h[:own] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def gram_counts(text: str) -> np.ndarray:
    """How often each feature occurs in a text."""
    out = np.zeros(DIMENSIONS, np.int64)
    for g in gram_numbers(text):
        out += np.bincount(g, minlength=DIMENSIONS)
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    #: idf * weight per feature and label, and the bias
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for grams in gram_numbers(text):
            total += self.weight[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total / max(1, n) * _SCALE + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.labels[k], float(p[k] / p.sum())


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], weights: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3) -> LanguageModel:
    """rows: (feature numbers, term frequencies); weights: the idf of each feature. FTRL-proximal, one row a step."""
    names = sorted(set(labels))
    k = len(names)
    y = np.array([names.index(x) for x in labels], int)
    rng = np.random.default_rng(seed)
    aside = rng.random(len(rows)) < 0.2
    if k < 2 or len({*y[~aside].tolist()}) < k:
        aside[:] = False
    train = np.flatnonzero(~aside)
    z, g2 = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))  # the last row is the bias, unpenalised

    def current(f: np.ndarray) -> np.ndarray:
        zf, nf = z[f], g2[f]
        first = np.where(f == DIMENSIONS, 0.0, l1)[:, None]
        second = np.where(f == DIMENSIONS, 0.0, l2)[:, None]
        return np.where(np.abs(zf) <= first, 0.0, -(zf - np.sign(zf) * first) / ((beta + np.sqrt(nf)) / alpha + second))

    feats = [(np.append(f, DIMENSIONS).astype(np.int32), np.append(tf * weights[f] * _SCALE, 1.0).astype(np.float32)) for f, tf in rows]
    for _ in range(epochs if k > 1 else 0):
        for i in rng.permutation(train):
            f, x = feats[i]
            w = current(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            n = g2[f]
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z[f] += g - sigma * w
            g2[f] = n + g * g
    w = np.zeros((DIMENSIONS + 1, k))
    for a in range(0, DIMENSIONS + 1, 1 << 14):
        part = np.arange(a, min(a + (1 << 14), DIMENSIONS + 1))
        w[part] = current(part)
    temperature = 1.0
    if aside.any():
        held = np.flatnonzero(aside)
        logit = np.array([feats[i][1] @ w[feats[i][0]] for i in held])

        def loss(t: float) -> float:
            s = logit / t
            top = s.max(axis=1)
            return float(np.mean(np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(held)), y[held]]))

        lo, hi = np.log(0.05), np.log(20.0)
        for _ in range(60):  # golden section on the logarithm; the loss has one minimum
            a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
            lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
        temperature = float(np.exp((lo + hi) / 2))
    return LanguageModel(names, (w[:DIMENSIONS] * weights[:, None]).astype(np.float32), w[DIMENSIONS], temperature)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's rows, and under feature -1 its number of documents."""
    df, n, seen = np.zeros(DIMENSIONS, np.int64), 0, np.zeros(DIMENSIONS, bool)
    for batch in batches:
        for t in batch.column("t"):
            for g in gram_numbers(t.as_py()):
                seen[g] = True
            hit = np.flatnonzero(seen)
            df[hit] += 1
            seen[hit] = False
            n += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"f": pa.array(np.append(some, -1), pa.int64()), "n": pa.array(np.append(df[some], n), pa.int64())})


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the features of their text and each one's share, 8 bytes each."""
    for batch in batches:
        for i, y, t in zip(batch.column("id").cast(pa.string()), batch.column("y"), batch.column("t"), strict=True):
            text = t.as_py()
            if len(text) <= _PIECE:
                f, n = np.unique(np.concatenate([*gram_numbers(text), np.zeros(0, np.uint32)]).astype(np.int64), return_counts=True)
            else:
                n = gram_counts(text)
                f = np.flatnonzero(n)
                n = n[f]
            pairs = np.empty(len(f), [("f", np.int32), ("tf", np.float32)])
            pairs["f"], pairs["tf"] = f, n / max(1, n.sum())
            yield pa.RecordBatch.from_pydict({"id": pa.array([i.as_py()], pa.string()), "y": pa.array([y.as_py()], pa.string()), "x": pa.array([pairs.tobytes()], pa.binary())})


def train_language(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "lang", max_train: int = 6000, seed: int = 3) -> LanguageModel:
    """Learn from the documents for which `learn` holds and the label is not null; weights from about `max_train`."""
    base = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y"))
    got = base.select("t").mapInArrow(_counts, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # one row a feature at most
    f, n = got["f"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    total = int(n[f < 0].sum())
    df = np.zeros(DIMENSIONS, np.int64)
    df[f[f >= 0]] = n[f >= 0]
    if not total:
        return LanguageModel([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)
    share = min(1.0, max_train / total)
    some = base.where(F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    once = some.select("id", "t", "y").mapInArrow(_frequencies, "id string, y string, x binary").groupBy("id", "y", "x").count()  # repeated rows once
    got = once.select("id", "y", "x").toArrow().sort_by([("y", "ascending"), ("x", "ascending"), ("id", "ascending")])
    if not got.num_rows:
        return LanguageModel([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)
    pairs = [np.frombuffer(x.as_py(), [("f", np.int32), ("tf", np.float32)]) for x in got["x"]]
    return fit([(p["f"], p["tf"]) for p in pairs], got["y"].to_pylist(), idf(df, total), seed=seed)


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) plus lang_pred and score (names get an underscore if taken)."""
    keep = docs.columns if keep is None else keep
    lang, score = first_free(keep, "lang_pred"), first_free(keep, "score")
    base = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    schema = T.StructType([f for f in base.schema.fields if f.name != "t"] + [T.StructField("l", T.StringType()), T.StructField("s", T.DoubleType())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**17 features, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.predict(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "t"} | {"l": pa.array([x for x, _ in out], pa.string()), "s": pa.array([x for _, x in out], pa.float64())})

    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("l").alias(lang), F.col("s").alias(score))
