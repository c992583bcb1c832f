"""k@n recall: the share of true neighbours that predictions hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import k_largest_dot, k_smallest_hamming


def recall(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: hits, n_true, recall. Both: query_id, neighbor_id.

    A repeated prediction counts each time; a repeated truth counts once as a target and each time in the denominator.
    """
    hits = predicted.join(truth.select("query_id", "neighbor_id").distinct(), ["query_id", "neighbor_id"], "left_semi").agg(F.count("*").alias("hits"))
    total = truth.agg(F.count("*").alias("n_true"))
    return hits.crossJoin(total).select("hits", "n_true", F.try_divide(F.col("hits"), F.col("n_true")).alias("recall"))  # a row each


def recall_of_codes(data_codes: DataFrame, query_codes: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """Codes against given true neighbours."""
    return recall(truth, k_smallest_hamming(data_codes, query_codes, n))


def recall_of_predictions(data: DataFrame, queries: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """Given predictions against true neighbours by dot product."""
    return recall(k_largest_dot(data, queries, k), predicted)


def recall_end_to_end(data: DataFrame, data_codes: DataFrame, queries: DataFrame, query_codes: DataFrame, k: int, n: int) -> DataFrame:
    return recall(k_largest_dot(data, queries, k), k_smallest_hamming(data_codes, query_codes, n))
