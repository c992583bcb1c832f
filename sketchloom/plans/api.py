"""One object for the search library: every operation by one name, over tables or matrices.

Methods take DataFrames (vec_id, embedding | code), numpy matrices (rows numbered from 0; a single row is a matrix of
one), or paths of matrix files with a data set's name as `(path, dataset)`, and return DataFrames in long form
(query_id, rank, neighbor_id, score).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import encode, index, knn, recall
from ..sources import hdf5
from ..sources import vectors as source
from . import train

Vectors = DataFrame | np.ndarray | tuple[str, str]


class SketchSearch:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def vectors(self, x: Vectors) -> DataFrame:
        if isinstance(x, DataFrame):
            return x
        if isinstance(x, tuple):
            return hdf5.read_hdf5(self.spark, *x)
        return source.from_numpy(self.spark, np.atleast_2d(np.asarray(x)))

    def codes(self, x: Vectors) -> DataFrame:
        if isinstance(x, DataFrame):
            return x
        if isinstance(x, tuple):
            return hdf5.read_hdf5(self.spark, *x, kind="code")
        return source.from_numpy(self.spark, np.ascontiguousarray(np.atleast_2d(np.asarray(x))), name="code")

    def pairs(self, x: DataFrame | np.ndarray) -> DataFrame:
        """Neighbour ids, a row per query, as (query_id, neighbor_id)."""
        if isinstance(x, DataFrame):
            return x
        rows = [(q, int(i)) for q, r in enumerate(np.asarray(x)) for i in r]
        return self.spark.createDataFrame(rows, "query_id long, neighbor_id long")

    def trainer(self, data: Vectors, n_bits: int, **options) -> train.DistributedTrainer:
        return train.DistributedTrainer(self.vectors(data), n_bits, **options)

    def stochastic_trainer(self, data: Vectors, sample_size: int, its_per_sample: int, n_bits: int, **options) -> train.StochasticTrainer:
        return train.StochasticTrainer(self.vectors(data), sample_size, its_per_sample, n_bits, **options)

    def encode(self, data: Vectors, centers: np.ndarray, word_bits: int = 64) -> DataFrame:
        return encode.encode(self.vectors(data), centers, word_bits)

    def encode_file(self, data: Vectors, centers: np.ndarray, out: tuple[str, str], word_bits: int = 64) -> None:
        """Codes of a matrix as a data set of a matrix file."""
        codes = self.encode(data, centers, word_bits)
        hdf5.store_hdf5(codes, *out, embedding="code", dtype=f"u{min(word_bits, 64) // 8}")

    def k_largest_dot(self, data: Vectors, queries: Vectors, k: int) -> DataFrame:
        return knn.k_largest_dot(self.vectors(data), self.vectors(queries), k)

    def k_smallest_hamming(self, codes: Vectors, query_codes: Vectors, k: int) -> DataFrame:
        return knn.k_smallest_hamming(self.codes(codes), self.codes(query_codes), k)

    def cascade_hamming(self, codes: Sequence[Vectors], query_codes: Sequence[Vectors], ks: Sequence[int]) -> DataFrame:
        return knn.cascade_hamming([(self.codes(a), self.codes(b)) for a, b in zip(codes, query_codes, strict=True)], ks)

    def refine(self, data: Vectors, queries: Vectors, candidates: DataFrame | np.ndarray, k: int) -> DataFrame:
        return knn.refine_dot(self.vectors(data), self.vectors(queries), self.pairs(candidates), k)

    def refine_with_other_code(self, codes: Vectors, query_codes: Vectors, candidates: DataFrame | np.ndarray, k: int) -> DataFrame:
        return knn.refine_code(self.codes(codes), self.codes(query_codes), self.pairs(candidates), k)

    def query(self, data: Vectors, codes: Vectors, queries: Vectors, query_codes: Vectors, k: int, n: int) -> DataFrame:
        return knn.query(self.vectors(data), self.codes(codes), self.vectors(queries), self.codes(query_codes), k, n)

    def query_cascade(self, data: Vectors, codes: Sequence[Vectors], queries: Vectors, query_codes: Sequence[Vectors], k: int, ns: Sequence[int]) -> DataFrame:
        return knn.query_cascade(self.vectors(data), [self.codes(c) for c in codes], self.vectors(queries), [self.codes(c) for c in query_codes], k, ns)

    def recall(self, truth: DataFrame | np.ndarray, predicted: DataFrame | np.ndarray) -> float | None:
        return recall.recall(self.pairs(truth), self.pairs(predicted)).first()["recall"]

    def recall_of_codes(self, codes: Vectors, query_codes: Vectors, truth: DataFrame | np.ndarray, n: int) -> float | None:
        return recall.recall_of_codes(self.codes(codes), self.codes(query_codes), self.pairs(truth), n).first()["recall"]

    def recall_of_predictions(self, data: Vectors, queries: Vectors, predicted: DataFrame | np.ndarray, k: int) -> float | None:
        return recall.recall_of_predictions(self.vectors(data), self.vectors(queries), self.pairs(predicted), k).first()["recall"]

    def recall_end_to_end(self, data: Vectors, codes: Vectors, queries: Vectors, query_codes: Vectors, k: int, n: int) -> float | None:
        return recall.recall_end_to_end(self.vectors(data), self.codes(codes), self.vectors(queries), self.codes(query_codes), k, n).first()["recall"]

    def index(self, codes: Vectors, layer_bits: int, fanout: int, total_bits: int, word_bits: int = 64) -> index.CodeIndex:
        return index.CodeIndex.build(self.codes(codes), layer_bits, fanout, total_bits, word_bits)

    def index_knn(self, built: index.CodeIndex, query_codes: Vectors, k: int) -> DataFrame:
        return built.knn(self.codes(query_codes), k)

    def index_range(self, built: index.CodeIndex, query_codes: Vectors, max_dist: int) -> DataFrame:
        return built.within(self.codes(query_codes), max_dist)

    @property
    def parallelism(self) -> int:
        """How many tasks run at once; set by the session's master or executor cores."""
        return self.spark.sparkContext.defaultParallelism

    def set_partitions(self, n: int) -> None:
        """How many tasks a shuffle is dealt to from now on (0: as many as run at once)."""
        self.spark.conf.set("spark.sql.shuffle.partitions", str(n if n > 0 else self.parallelism))
