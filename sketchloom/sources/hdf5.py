"""Matrix files as a Python data source: `spark.read.format("hdf5_matrix")` with options `path` and `dataset`.

A path is an HDF5 file, or a folder that holds each data set as an .npy file. Rows are numbered by position (vec_id).
Partitions are ranges of `rows_per_partition` rows, read as slices, and batches leave as Arrow. With `kind` "code" rows
are words of bit codes, else floats. The HDF5 library is imported only where such a file is opened; files must be on
storage that every executor mounts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FolderStore:
    """A folder of .npy files with what is needed of an HDF5 file."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> FolderStore:
        return self

    def __exit__(self, *_) -> None:
        pass

    def __getitem__(self, name: str) -> np.ndarray:
        return np.load(os.path.join(self.path, f"{name}.npy"), mmap_mode="r")

    def create_dataset(self, name: str, shape: tuple[int, ...], dtype: str) -> np.ndarray:
        os.makedirs(self.path, exist_ok=True)
        return np.lib.format.open_memmap(os.path.join(self.path, f"{name}.npy"), "w+", np.dtype(dtype), shape)


def _open(path: str, mode: str = "r"):
    if not path.endswith((".h5", ".hdf5")):
        return FolderStore(path)
    import h5py

    return h5py.File(path, mode)


class RowRange(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str], opener=_open):
        self.path, self.dataset = options["path"], options["dataset"]
        self.rows = int(options.get("rows_per_partition", 100_000))
        self.batch = int(options.get("batch_size", 1000))
        self.code = options.get("kind", "vector") == "code"
        self.opener = opener

    def partitions(self) -> list[RowRange]:
        with self.opener(self.path) as f:
            n = f[self.dataset].shape[0]
        return [RowRange(a, min(a + self.rows, n)) for a in range(0, n, self.rows)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        with self.opener(self.path) as f:
            data = f[self.dataset]
            for a in range(partition.start, partition.stop, self.batch):
                x = np.asarray(data[a : min(a + self.batch, partition.stop)])
                if self.code:  # words as they are, signed or not
                    x = x.view(f"u{x.dtype.itemsize}") if x.dtype.kind == "i" else x
                    x = x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
                else:
                    x = x.astype(np.float32)
                flat = pa.array(x.ravel())
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(np.arange(a, a + len(x), dtype=np.int64)), "code" if self.code else "embedding": pa.ListArray.from_arrays(off, flat)})


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5_matrix"

    def schema(self) -> str:
        return "vec_id long, code array<bigint>" if self.options.get("kind") == "code" else "vec_id long, embedding array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


def read_hdf5(spark: SparkSession, path: str, dataset: str, **options) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    return spark.read.format("hdf5_matrix").options(path=path, dataset=dataset, **options).load()


def store_hdf5(df: DataFrame, path: str, dataset: str, embedding: str = "embedding", data_id: str = "vec_id", opener=None, dtype: str = "f4", block: int = 10_000) -> None:
    """Write a matrix as one data set from the driver, a block of rows at a time in id order: for exchange, not for scale."""
    with opener(path) if opener is not None else _open(path, "a") as f:
        n, out, at = df.count(), None, 0
        rows = df.select(data_id, embedding).orderBy(data_id).toLocalIterator()
        while part := [r[1] for r in islice(rows, block)]:
            if out is None:
                out = f.create_dataset(dataset, shape=(n, len(part[0])), dtype=dtype)
            out[at : at + len(part)] = np.array(part).astype(dtype)
            at += len(part)
        if hasattr(out, "flush"):
            out.flush()
