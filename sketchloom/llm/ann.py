"""Nearest neighbours by cosine with multi-index hashing over learned rotated binary codes.

Fitting: `rotations` orthogonal matrices are learned on a bounded sample (`max_fit` rows, chosen by a hash of the row),
each alternated between signs and rotation (iterative quantisation) from its own random start; a code has one bit per
rotated coordinate. Codes are cut into m substrings of 16 bits. The radius is measured: for at most `fit_queries`
queries the true neighbours are found by one scan, and the radius is the least at which probing retrieves the share
`coverage` of them.

Search: at radius r, substring j is probed up to (r - j) // m flipped bits, so that any code within r bits of the query
has a substring that is probed (pigeonhole: the flips that escape all probes add up to r + 1). Rows are dealt evenly to
blocks; a task indexes a block once, a bucket list for each substring, and then streams all queries past it. What is
retrieved is reranked by the cosine of the original vectors in double precision, whatever its code distance, and the
best k of each block are shuffled. A query that retrieves fewer than k rows is searched again without a radius, so
nothing is cut off. Memory of a task is that of a block (`block_rows`); the driver holds the fitting sample alone.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; rows with the query's own id are its own; of repeated query ids the smallest vector asks; ties go to the
smaller id, null ids last; fewer candidates than k give fewer rows; an empty table gives an empty result; columns
beside the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_NO_ID = np.iinfo(np.int64).max
SUBSTRING_BITS = 16
_FLIPS = np.bitwise_count(np.arange(1 << SUBSTRING_BITS, dtype=np.uint16))


@dataclass
class BinaryCoder:
    #: dim x bits: the rotations side by side
    matrix: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings."""
        b = x @ self.matrix >= 0
        return np.packbits(np.pad(b, ((0, 0), (0, -b.shape[1] % SUBSTRING_BITS))), axis=1).view(np.uint16)


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Rotation that brings unit rows near to their signs."""
    d = x.shape[1]
    r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(rounds):
        b = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(x.T @ b)
        r = u @ vt
    return r


def flips_allowed(radius: int, m: int) -> list[int]:
    """How many flipped bits each substring is probed for at a radius; -1: not at all."""
    return [(radius - j) // m for j in range(m)]


def radius_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of codes: the least radius at which probing for one retrieves the other."""
    m = a.shape[-1]
    return (np.bitwise_count(a ^ b).astype(np.int64) * m + np.arange(m)).min(axis=-1)


def measured_radius(needed: np.ndarray, coverage: float) -> int:
    """The least radius that retrieves all but a share 1 - coverage of the pairs."""
    if not len(needed):
        return 0
    return int(np.sort(needed)[len(needed) - 1 - int((1 - coverage) * len(needed))])


class MultiIndex:
    """Buckets of a block's rows, a list for each substring, sorted by its value."""

    def __init__(self, codes: np.ndarray):
        self.n, self.m = codes.shape
        self.parts = []
        for j in range(self.m):
            value = np.ascontiguousarray(codes[:, j])
            order = np.argsort(value, kind="stable").astype(np.int32)
            start = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << SUBSTRING_BITS))]).astype(np.int32)
            filled = np.flatnonzero(np.diff(start)).astype(np.uint16)
            self.parts.append((order, start, filled))

    def probe(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Which rows (query x row) have a substring within the flips allowed of the query's."""
        found = np.zeros((len(queries), self.n), bool)
        for j, (flips, (order, start, filled)) in enumerate(zip(flips_allowed(radius, self.m), self.parts, strict=True)):
            if flips < 0:
                continue
            near = np.flatnonzero(_FLIPS <= flips).astype(np.uint16)
            q = queries[:, j]
            if len(filled) > 8 * len(near):  # the probes are few beside the buckets: look each one up
                key = q[:, None] ^ near[None, :]
                qi, at = np.nonzero(start[key.astype(np.int32) + 1] > start[key])
                key = key[qi, at]
            else:  # run through the filled buckets
                qi, at = np.nonzero(np.bitwise_count(q[:, None] ^ filled[None, :]) <= flips)
                key = filled[at]
            first, size = start[key], start[key.astype(np.int32) + 1] - start[key]
            row = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found[np.repeat(qi, size), order[row]] = True
        return found


def cosines(x: np.ndarray, q: np.ndarray, row: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Cosine of pairs, summed component by component in their order. x, q: component x vector."""
    s = np.zeros(len(row))
    for a, b in zip(x, q, strict=True):
        s += a[row] * b[qi]
    return s


def norms(x: np.ndarray) -> np.ndarray:
    s = np.zeros(x.shape[1])
    for a in x:
        s += a * a
    return np.sqrt(s)


class Block:
    """Vectors of a block with their index; searched by some queries at a time."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, coder: BinaryCoder | None):
        self.ids, self.coder = ids, coder
        self.x = np.ascontiguousarray(x.T)
        self.norm = norms(self.x)
        self.index = MultiIndex(coder.codes(x)) if coder is not None else None
        self.probed = 0

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and cosine of up to k best rows for each query."""
        hit = self.index.probe(self.coder.codes(q), self.coder.radius) if self.index is not None else np.ones((len(q), len(self.ids)), bool)
        self.probed += int(hit.sum())
        qi, row = np.nonzero(hit & (self.ids[None, :] != q_ids[:, None]))
        qt = np.ascontiguousarray(q.T)
        s = cosines(self.x, qt, row, qi) / (self.norm[row] * norms(qt)[qi])
        return best(qi, self.ids[row], s, k)


def best(qi: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by falling score, then id."""
    order = np.lexsort((ids, -s, qi))
    qi, ids, s = qi[order], ids[order], s[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, "left") < k
    return qi[keep], ids[keep], s[keep]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(_NO_ID) if column.null_count else column, dtype=np.int64)


def _answer(q_ids: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids, pa.int64()), "vec_id": pa.array(ids, pa.int64(), mask=ids == _NO_ID), "score": pa.array(s, pa.float64())})


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int, int]:
    """id and v (floats or doubles) of the rows that take part, their length and their number."""
    kind = vectors.schema[embedding].dataType.simpleString()
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = base.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    size = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (size["d"], size["count"]) if size else (0, 0)
    return base.where(F.size("v") == dim), dim, n


_FOUND = "query_id long, vec_id long, score double"


def _scan(rows: DataFrame, asked: list, dim: int, k: int) -> DataFrame:
    """The true neighbours of a few queries, by one pass over all rows; with their vectors."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64)))  # at most fit_queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        none = np.zeros(0, np.int64)
        held = (none, none, np.zeros(0), np.zeros((0, dim)))
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                ids, x = _ids(part.column("id")), _matrix(part.column("v"), dim)
                s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                s[ids[None, :] == q_ids[:, None]] = -np.inf
                top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                qi, row = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
                new = (qi, row, s[qi, row], x[row])
                keep = np.isfinite(new[2])
                held = tuple(np.concatenate([h, y[keep]]) for h, y in zip(held, (qi, ids[row], new[2], x[row]), strict=True))
                order = np.lexsort((held[1], -held[2], held[0]))
                first = np.arange(len(order)) - np.searchsorted(held[0][order], held[0][order], "left") < k
                held = tuple(h[order[first]] for h in held)
        qi, ids, s, v = held
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[qi]), "vec_id": pa.array(ids), "score": pa.array(s), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})

    return top(rows.select("id", "v").mapInArrow(run, f"{_FOUND}, v array<double>"), k, "v")


def fit_coder(rows: DataFrame, asked: DataFrame, dim: int, total: int, k: int, max_fit: int, fit_queries: int, rotations: int, coverage: float, seed: int) -> BinaryCoder:
    share = min(1.0, max_fit / total)
    some = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).groupBy("id", "v").count()  # repeated rows once
    x = np.array(sorted(r["v"] for r in some.collect()), dtype=np.float64).reshape(-1, dim)
    first = asked.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_queries).collect()
    if not len(x):
        x = np.array([r["v"] for r in first], np.float64)
    rng = np.random.default_rng(seed)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coder = BinaryCoder(np.hstack([learn_rotation(x, rng) for _ in range(rotations)]), 0)
    near = _scan(rows, first, dim, k).select("query_id", "v").collect()
    own = {r["id"]: c for r, c in zip(first, coder.codes(np.array([r["v"] for r in first], np.float64)), strict=True)}
    if near:
        codes = coder.codes(np.array([r["v"] for r in near], np.float64))
        coder.radius = measured_radius(radius_needed(codes, np.array([own[r["query_id"]] for r in near])), coverage)
    return coder


def search(rows: DataFrame, asked: DataFrame, blocks: int, dim: int, k: int, coder: BinaryCoder | None) -> DataFrame:
    """The best k of every block for each query, by the index or, without a coder, by all rows. rows: id, v, block."""
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "v")
    dealt = rows.select(F.col("block").cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v").unionByName(every)
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = -1, [], None
        for batch in batches:
            key = np.asarray(batch.column("block")).astype(np.int64) * 2 + np.asarray(batch.column("asks"))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                number, asks = divmod(int(key[a]), 2)
                if number != now:
                    now, held, block = number, [], None
                part = batch.slice(a, b - a)
                ids, v = _ids(part.column("id")), _matrix(part.column("v"), dim)
                if not asks:
                    held.append((ids, v))
                    continue
                if block is None and held:
                    block = Block(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), coder)
                    held = []
                for c in range(0, len(ids) if block is not None else 0, 64):
                    qi, found, s = block.search(ids[c : c + 64], v[c : c + 64], k)
                    yield _answer(ids[c + qi], found, s)

    return dealt.mapInArrow(run, _FOUND)


def nearest(
    vectors: DataFrame, is_query: str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", max_fit: int = 4000, fit_queries: int = 256, rotations: int = 8, coverage: float = 0.985, block_rows: int = 1 << 18, seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score. `is_query` is a SQL condition on a column `id`."""
    spark = vectors.sparkSession
    base, dim, total = usable(vectors, vec_id, embedding)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_rows))
    rows = materialize(base.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))) if total else base
    asked = materialize(rows.where(f"id is not null and ({is_query})").groupBy("id").agg(F.min("v").alias("v"))) if total else base
    if not total or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = fit_coder(rows, asked, dim, total, k, max_fit, fit_queries, rotations, coverage, seed)
    first = materialize(top(search(rows, asked, blocks, dim, k, coder), k))
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = materialize(asked.join(full, asked["id"] == full["query_id"], "left_anti"))
    if short.isEmpty():
        return first
    again = top(search(rows, short, blocks, dim, k, None), k)
    return first.join(full, "query_id", "left_semi").unionByName(again).select("query_id", "rank", "vec_id", "score")


def top(found: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)
