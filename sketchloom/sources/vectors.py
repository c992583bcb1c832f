"""Vector tables: reading, row access, writing, and exchange with numpy. Identity is the id column, never a position."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types by their array-library names and what holds them in a table.
ELEMENT_TYPES = {
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "bool": "boolean",
    "uint8": "bigint",
    "uint16": "bigint",
    "uint32": "bigint",
    "uint64": "bigint",
    "int8": "bigint",
    "int16": "bigint",
    "int32": "bigint",
    "int64": "bigint",
}


def spark_type(dtype) -> str:
    name = np.dtype(dtype).name
    if name not in ELEMENT_TYPES:
        raise ValueError(f"unsupported element type {name}")
    return ELEMENT_TYPES[name]


def read_vectors(spark: SparkSession, path: str, data_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(F.col(data_id).alias("vec_id"), F.col(embedding).alias("embedding"))


def from_numpy(spark: SparkSession, x: np.ndarray, first_id: int = 0, name: str = "embedding") -> DataFrame:
    """Rows of a matrix, ids counted from first_id. Half floats become floats; words keep their bits.

    Words may be signed: their bits are read as those of the unsigned word of the same width. A matrix of 128-bit words
    has two columns of 64 bits for each, the low half first.
    """
    kind = spark_type(x.dtype)
    x = x.view(f"u{x.dtype.itemsize}") if x.dtype.kind == "i" else x
    rows = x.astype(np.float32) if x.dtype == np.float16 else x.view(np.int64) if x.dtype == np.uint64 else x
    pdf = pd.DataFrame({"vec_id": np.arange(first_id, first_id + len(x), dtype=np.int64), name: [r.tolist() for r in rows]})
    return spark.createDataFrame(pdf, f"vec_id long, {name} array<{kind}>")


def to_numpy(df: DataFrame, value: str = "embedding", data_id: str = "vec_id", dtype=None) -> tuple[np.ndarray, np.ndarray]:
    """ids and rows, by id: for results that fit the driver."""
    got = df.select(data_id, value).orderBy(data_id).collect()
    x = np.array([r[1] for r in got])
    if dtype is not None:
        x = x.astype(np.int64).view(np.uint64).astype(dtype) if np.dtype(dtype).kind == "u" else x.astype(dtype)
    return np.array([r[0] for r in got]), x


def n_rows(df: DataFrame) -> int:
    return df.count()


def n_cols(df: DataFrame, embedding: str = "embedding") -> int:
    """Length of the vectors; an error if they differ."""
    got = df.where(F.col(embedding).isNotNull()).agg(F.min(F.size(embedding)).alias("a"), F.max(F.size(embedding)).alias("b")).first()
    if got["a"] != got["b"]:
        raise ValueError("vectors differ in length")
    return got["a"] or 0


def get_row(df: DataFrame, i: int, data_id: str = "vec_id") -> DataFrame:
    return df.where(F.col(data_id) == i)


def get_rows(df: DataFrame, ids: list[int] | DataFrame, data_id: str = "vec_id") -> DataFrame:
    """The rows of some ids with their place in the request (`pos`); a repeated id gives its row each time."""
    spark = df.sparkSession
    asked = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(p, int(i)) for p, i in enumerate(ids)], "pos long, __id long")
    return asked.join(df, F.col("__id") == F.col(data_id)).drop("__id")


def get_rows_slice(df: DataFrame, start: int, stop: int, data_id: str = "vec_id") -> DataFrame:
    """Ids start .. stop - 1; a Parquet scan skips row groups outside."""
    return df.where((F.col(data_id) >= start) & (F.col(data_id) < stop))


def quantise_half(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Elements rounded to half precision, kept as floats (tables have no half type)."""
    names = df.columns
    flat = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(embedding)}"
    flat = flat.withColumn(at, F.col(at).cast("array<float>"))

    def run(batches):
        for batch in batches:
            v = batch.column(at)
            flat_values = v.flatten()
            half = pa.array(np.asarray(flat_values, np.float32).astype(np.float16).astype(np.float32), mask=np.asarray(flat_values.is_null()))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(v), 0))
            off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(np.asarray(v.is_null()), False))
            out = pa.ListArray.from_arrays(off, half)
            yield pa.RecordBatch.from_pydict({c: out if c == at else batch.column(c) for c in batch.schema.names})

    out = flat.mapInArrow(run, flat.schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists", bucket: int | None = None, table: str | None = None, data_id: str = "vec_id") -> None:
    """Parquet; with `bucket` and `table`, a table bucketed by id, so later joins on it need no shuffle."""
    if bucket:
        df.write.mode(mode).format("parquet").bucketBy(bucket, data_id).sortBy(data_id).saveAsTable(table, path=path)
    else:
        df.write.mode(mode).parquet(path)
