"""The best k rows of each query: ranking over scored pairs, and a blocked scan for all-pairs scoring.

Order: score (largest or smallest first), then the neighbour's id. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A block scorer: (query rows, data rows) -> scores, queries x data; and a pair scorer for exact re-scoring.
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rank_pairs(pairs: DataFrame, k: int, score: str, largest: bool) -> DataFrame:
    """pairs: query_id, neighbor_id, score -> query_id, rank, neighbor_id, score."""
    first = F.col(score).desc() if largest else F.col(score).asc()
    order = Window.partitionBy("query_id").orderBy(first, F.col("neighbor_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", score)


def as_matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a list column as a matrix; all lists must have one length."""
    n = len(column)
    flat = np.asarray(column.flatten())
    if n == 0:
        return np.zeros((0, 0), dtype)
    if flat.size % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1).astype(dtype, copy=False)


def keep_best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, largest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query number."""
    order = np.lexsort((ids, -s if largest else s, q))
    q, ids, s = q[order], ids[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], ids[keep], s[keep]


Best = tuple[np.ndarray, np.ndarray, np.ndarray]
_NONE: Best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def score_block(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: Scorer, exact: Scorer | None, largest: bool) -> Best:
    """The best k (query number, id, score) so far, after some more data rows."""
    for a in range(0, len(x), 4096):
        part, part_ids = x[a : a + 4096], ids[a : a + 4096]
        s = block(q, part)
        if s.shape[1] > k:
            edge = np.partition(-s if largest else s, k - 1, axis=1)[:, k - 1 : k]
            slack = 1e-9 * (1 + np.abs(edge)) if exact else 0
            qi, row = np.nonzero((-s if largest else s) <= edge + slack)
        else:
            qi, row = (i.ravel() for i in np.indices(s.shape))
        value = exact(q[qi], part[row]) if exact else s[qi, row]
        qi, i, value = (np.concatenate(z) for z in zip(best, (qi, part_ids[row], value), strict=True))
        best = keep_best(qi, i, value, k, largest)
    return best


def deal_blocks(rows: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt evenly to blocks, and every query sent to each; a block's rows come before the queries. Columns id, v."""
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "v")
    dealt = rows.select(number.alias("block"), F.lit(0).alias("asks"), "id", "v").unionByName(every)
    return dealt.repartition(blocks, "block").sortWithinPartitions("block", "asks")


def scan_topk(
    data: DataFrame, data_id: str, data_col: str, queries: DataFrame, query_id: str, query_col: str, k: int, block: Scorer, exact: Scorer | None, largest: bool, dtype, score: str, score_type: str, query_block: int = 2048, block_rows: int = 1 << 18
) -> DataFrame:
    """Score every data row against every query, in blocks, and rank.

    Up to `query_block` queries are brought to the data where it lies, so what is broadcast has a fixed bound. More of
    them are streamed past blocks of at most about `block_rows` data rows, which one shuffle deals out; the driver never
    holds them. Each task keeps its best k per query, and only those are shuffled. If `exact` is given, `block` only
    selects (its rounding may depend on the block's shape) and `exact` scores the selected pairs.
    """
    spark = data.sparkSession
    kind = "array<double>" if np.dtype(dtype).kind == "f" else "array<bigint>"
    rows = data.where(F.col(data_id).isNotNull() & F.col(data_col).isNotNull()).select(F.col(data_id).cast("long").alias("id"), F.col(data_col).cast(kind).alias("v"))
    asked = queries.where(F.col(query_id).isNotNull() & F.col(query_col).isNotNull()).select(F.col(query_id).cast("long").alias("id"), F.col(query_col).cast(kind).alias("v"))
    schema = f"query_id long, neighbor_id long, {score} {score_type}"

    def answer(q_ids: np.ndarray, best: Best) -> pa.RecordBatch:
        qi, i, value = best
        value = pa.array(value).cast(pa.float64() if score_type == "double" else pa.int32(), safe=False)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[qi.astype(np.int64)], pa.int64()), "neighbor_id": pa.array(i.astype(np.int64)), score: value})

    some = asked.limit(query_block + 1).count()
    if not some:
        return rank_pairs(spark.createDataFrame([], schema), k, score, largest)
    if some <= query_block:
        got = asked.orderBy("id").collect()
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in got], np.int64), np.array([r["v"] for r in got], dtype)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            best = _NONE
            for batch in batches:
                best = score_block(best, q, as_matrix(batch.column("v"), dtype), np.asarray(batch.column("id")), k, block, exact, largest)
            yield answer(q_ids, best)

        return rank_pairs(rows.mapInArrow(run, schema), k, score, largest)

    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // block_rows))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            key = np.asarray(batch.column("block")).astype(np.int64) * 2 + np.asarray(batch.column("asks"))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                number, asks = divmod(int(key[a]), 2)
                if number != now:
                    now, held = number, []
                part = batch.slice(a, b - a)
                ids, v = np.asarray(part.column("id")), as_matrix(part.column("v"), dtype)
                if not asks:
                    held.append((ids, v))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(z) for z in zip(*held, strict=True))]
                for c in range(0, len(ids) if held else 0, 512):
                    yield answer(ids[c : c + 512], score_block(_NONE, v[c : c + 512], held[0][1], held[0][0], k, block, exact, largest))

    return rank_pairs(deal_blocks(rows, asked, blocks).mapInArrow(stream, schema), k, score, largest)
