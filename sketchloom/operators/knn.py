"""Exact search, candidate refinement and multi-stage filter-and-refine over vectors and bit codes.

Results are long: (query_id, rank, neighbor_id, dot | dist), best first, ties by id. Rows with null ids or values
take no part. `method="sql"` writes all pairs as a join with array expressions (Catalyst plans it, and broadcasts a
side only below its own size threshold); the default `method="arrow"` scores blocks with vectorised kernels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, vectors
from .topk import rank_pairs, scan_topk


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def _pair_dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, x)


def _hammings(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Over the words that both codes have."""
    n = min(q.shape[1], x.shape[1])
    q, x = np.ascontiguousarray(q).view(np.uint64), np.ascontiguousarray(x).view(np.uint64)  # of a signed word numpy counts the magnitude
    out = np.zeros((len(q), len(x)), np.int32)
    for w in range(n):
        out += np.bitwise_count(q[:, None, w] ^ x[None, :, w])
    return out


def _all_pairs(data: DataFrame, data_id: str, a: str, queries: DataFrame, query_id: str, b: str, score: Column, name: str) -> DataFrame:
    """score: an expression of __a (data) and __b (query)."""
    x = data.select(F.col(data_id).alias("neighbor_id"), F.col(a).alias("__a")).where("neighbor_id is not null and __a is not null")
    y = queries.select(F.col(query_id).alias("query_id"), F.col(b).alias("__b")).where("query_id is not null and __b is not null")
    return x.crossJoin(y).select("query_id", "neighbor_id", score.alias(name))


def k_largest_dot(data: DataFrame, queries: DataFrame, k: int, data_id: str = "vec_id", data_col: str = "embedding", query_id: str = "vec_id", query_col: str = "embedding", method: str = "arrow") -> DataFrame:
    """Maximum inner product search."""
    if method == "sql":
        pairs = _all_pairs(data, data_id, data_col, queries, query_id, query_col, vectors.dot(F.col("__a"), F.col("__b")), "dot")
        return rank_pairs(pairs, k, "dot", True)
    return scan_topk(data, data_id, data_col, queries, query_id, query_col, k, _dots, _pair_dots, True, np.float64, "dot", "double")


def k_smallest_hamming(data: DataFrame, queries: DataFrame, k: int, data_id: str = "vec_id", data_col: str = "code", query_id: str = "vec_id", query_col: str = "code", method: str = "arrow") -> DataFrame:
    if method == "sql":
        pairs = _all_pairs(data, data_id, data_col, queries, query_id, query_col, bits.hamming(F.col("__a"), F.col("__b")), "dist")
        return rank_pairs(pairs, k, "dist", False)
    return scan_topk(data, data_id, data_col, queries, query_id, query_col, k, _hammings, None, False, np.int64, "dist", "int")


#: Candidate pairs (two ids and a distance each) up to this many are brought to the data instead of the data to them.
BROADCAST_PAIRS = 500_000


def _score_candidates(candidates: DataFrame, data: DataFrame, queries: DataFrame, data_id: str, data_col: str, query_id: str, query_col: str, keep: list[str], rows: int | None = None) -> DataFrame:
    """Candidates with the data and query values beside them: two equi-joins on ids, so unsorted ids pair rightly.

    `rows`: a bound of the number of candidates, if one is known. The id pairs meet the data first, since they are
    narrow; beyond the bound, or without one, Catalyst plans the join by the tables' sizes.
    """
    pairs = candidates.select("query_id", "neighbor_id", *keep).dropDuplicates(["query_id", "neighbor_id"])
    if rows is not None and rows <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    x = data.select(F.col(data_id).alias("neighbor_id"), F.col(data_col).alias("__a")).where("__a is not null")
    y = queries.select(F.col(query_id).alias("query_id"), F.col(query_col).alias("__b")).where("__b is not null")
    return x.join(pairs, "neighbor_id").join(y, "query_id")


def refine_dot(
    data: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, data_id: str = "vec_id", data_col: str = "embedding", query_id: str = "vec_id", query_col: str = "embedding", candidate_rows: int | None = None
) -> DataFrame:
    """The k candidates (query_id, neighbor_id) of largest dot product. `candidate_rows`: a bound of their number, if known."""
    scored = _score_candidates(candidates, data, queries, data_id, data_col, query_id, query_col, [], candidate_rows)
    return rank_pairs(scored.select("query_id", "neighbor_id", vectors.dot(F.col("__a"), F.col("__b")).alias("dot")), k, "dot", True)


def refine_code(
    data: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, data_id: str = "vec_id", data_col: str = "code", query_id: str = "vec_id", query_col: str = "code", candidate_rows: int | None = None
) -> DataFrame:
    """The k candidates nearest by another code; earlier distances do not count."""
    scored = _score_candidates(candidates, data, queries, data_id, data_col, query_id, query_col, [], candidate_rows)
    return rank_pairs(scored.select("query_id", "neighbor_id", bits.hamming(F.col("__a"), F.col("__b")).alias("dist")), k, "dist", False)


def cascade_hamming(
    stages: Sequence[tuple[DataFrame, DataFrame]], ks: Sequence[int], data_id: str = "vec_id", data_col: str = "code", query_id: str = "vec_id", query_col: str = "code", method: str = "arrow", n_queries: int | None = None
) -> DataFrame:
    """stages: (data codes, query codes) of each; stage s keeps ks[s] of its predecessor's by the distance summed so far."""
    if not stages or len(stages) != len(ks):
        raise ValueError("a cascade needs as many sizes as stages, and one at least")
    if n_queries is None and len(stages) > 1:
        n_queries = stages[0][1].count()
    now, had = k_smallest_hamming(*stages[0], ks[0], data_id, data_col, query_id, query_col, method), ks[0]
    for (data, queries), k in zip(stages[1:], ks[1:], strict=True):
        scored = _score_candidates(now, data, queries, data_id, data_col, query_id, query_col, ["dist"], n_queries * had)
        now, had = rank_pairs(scored.select("query_id", "neighbor_id", (F.col("dist") + bits.hamming(F.col("__a"), F.col("__b"))).alias("dist")), k, "dist", False), k
    return now


def query(data: DataFrame, data_codes: DataFrame, queries: DataFrame, query_codes: DataFrame, k: int, n: int, method: str = "arrow") -> DataFrame:
    """Filter by code (n), refine by dot product (k)."""
    if k > n:
        raise ValueError("k must not exceed n")
    return query_cascade(data, [data_codes], queries, [query_codes], k, [n], method)


def query_cascade(data: DataFrame, data_codes: Sequence[DataFrame], queries: DataFrame, query_codes: Sequence[DataFrame], k: int, ns: Sequence[int], method: str = "arrow") -> DataFrame:
    if not data_codes or not len(data_codes) == len(query_codes) == len(ns):
        raise ValueError("a cascade needs as many query codes and sizes as data codes, and one at least")
    n_queries = queries.count()
    found = cascade_hamming(list(zip(data_codes, query_codes, strict=True)), ns, method=method, n_queries=n_queries)
    return refine_dot(data, queries, found, k, candidate_rows=n_queries * ns[-1])
