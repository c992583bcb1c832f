"""Vectors to bit codes: bit i is 1 if the dot product with center i is at least 0 (a NaN product gives 0)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.bits import n_elements, stored_bits
from .topk import as_matrix

WORD_BITS = (8, 16, 32, 64, 128)


def _check(n_bits: int, word_bits: int) -> None:
    if n_bits < 1:
        raise ValueError("the number of bits should be at least 1")
    if word_bits not in WORD_BITS:
        raise ValueError(f"words have {WORD_BITS} bits")


def pack_bits(b: np.ndarray, word_bits: int = 64) -> np.ndarray:
    """Rows of 0/1 -> rows of words as int64, least significant bit first."""
    words, word_bits = n_elements(b.shape[1], word_bits), stored_bits(word_bits)
    padded = np.zeros((len(b), words * word_bits), np.uint8)
    padded[:, : b.shape[1]] = b
    raw = np.packbits(padded, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{word_bits // 8}").astype(np.uint64).view(np.int64)


def encode_expr(embedding: Column, centers: np.ndarray, word_bits: int = 64) -> Column:
    """A code as one expression, the centers being literals: for few bits."""
    centers = np.asarray(centers, float)
    _check(len(centers), word_bits)
    words, word_bits, rounded = [], stored_bits(word_bits), n_elements(len(centers), word_bits)
    for a in range(0, len(centers), word_bits):
        at = [F.array(*[F.lit(float(x)) for x in c]) for c in centers[a : a + word_bits]]
        # at least 0 and not NaN, which sorts above every number
        on = lambda c: F.coalesce(vectors.dot(embedding, c).between(0.0, float("inf")), F.lit(False))
        word = F.lit(0).cast("long")
        for i, c in enumerate(at):
            word = word.bitwiseOR(F.when(on(c), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.array(*words, *[F.lit(0).cast("long")] * (rounded - len(words)))


def encode_join(data: DataFrame, centers: DataFrame, word_bits: int = 64, data_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, code as a plan: every vector meets every center (bit_idx, center), and bits are gathered by word.

    Words of 128 bits are left to `encode`.
    """
    if stored_bits(word_bits) != word_bits:
        raise ValueError("this form takes words of at most 64 bits")
    x = data.select(F.col(data_id).alias("vec_id"), F.col(embedding).alias("__a")).where("vec_id is not null and __a is not null")
    dot = vectors.dot(F.col("__a"), F.col("center"))
    bit = F.when((dot >= 0) & ~F.isnan(dot), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit_idx") % word_bits).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = x.crossJoin(centers.select("bit_idx", "center")).groupBy("vec_id", F.floor(F.col("bit_idx") / word_bits).alias("w")).agg(F.bit_or(bit).alias("word"))
    return words.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda s: s["word"]).alias("code"))


def encode(data: DataFrame, centers: np.ndarray, word_bits: int = 64, embedding: str = "embedding", code: str = "code", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the vector) plus the code, by one matrix product per batch.

    No shuffle; it works on streams too. Rows with a null vector get a null code.
    """
    centers = np.ascontiguousarray(np.asarray(centers, np.float64))
    _check(len(centers), word_bits)
    keep = [c for c in data.columns if c not in (embedding, code)] if keep is None else keep
    base = data.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(embedding).cast("array<double>").alias("v"))
    schema = T.StructType([f for f in base.schema.fields if f.name != "v"] + [T.StructField("code", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            known = v.is_valid()
            x = as_matrix(v.filter(known), np.float64)
            with np.errstate(invalid="ignore"):
                b = (x @ centers.T >= 0).astype(np.uint8) if len(x) else np.zeros((0, len(centers)), np.uint8)
            words = pack_bits(b, word_bits)
            codes = iter(words.tolist())
            out = pa.array([next(codes) if k else None for k in known.to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "v"} | {"code": out})

    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("code").alias(code))


def centers_of(data: DataFrame, n_bits: int, first: int = 0, data_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Data rows with ids first .. first + n_bits - 1 as centers: bit_idx, center."""
    at = F.col(data_id) - first
    return data.where((at >= 0) & (at < n_bits)).select(at.cast("int").alias("bit_idx"), F.col(embedding).cast("array<double>").alias("center"))


def center_matrix(centers: DataFrame) -> np.ndarray:
    """Centers as a matrix: n_bits rows, whatever the data's size."""
    return np.array([r["center"] for r in centers.orderBy("bit_idx").collect()], np.float64)
