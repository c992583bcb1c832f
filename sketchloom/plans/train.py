"""Training hyperplanes whose sign bits are as independent as possible.

The state is small: centers (bits x dims) and, for each pair of bits, on how many rows they agree. `LocalTrainer`
keeps a bounded sample in memory; `DistributedTrainer` computes the agreements in one pass over a DataFrame per step;
`StochasticTrainer` runs local steps over one seeded sample after another, so Spark is asked only when a new sample
is due. All randomness comes from the seed.

A step turns a center away from those it agrees with too often (or too seldom). Moved rows replace the old ones in a
copy of the centers; the others stay. Coincident points and parallel centers give no direction and are skipped, and
the turning angle is kept below a right angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import stored_bits
from ..operators import encode, sampling
from ..operators.topk import as_matrix

_RIGHT_ANGLE = np.pi / 2 * (1 - 1e-6)


def similarity(overlap: np.ndarray, n: int) -> np.ndarray:
    """How far pairs of bits are from agreeing half of the time; 0 on the diagonal."""
    sim = np.abs(overlap / max(n, 1) - 0.5)
    np.fill_diagonal(sim, 0.0)
    return sim


def displacement(centers: np.ndarray, overlap: np.ndarray, n: int, i: int, j: int, scale: float) -> np.ndarray:
    """Where pair (i, j) pushes center i: away from the part of center j that is orthogonal to it, by a tangent."""
    equal = overlap[i, j] / n
    angle = np.clip((2 * equal - 1) * np.pi / 2 * scale, -_RIGHT_ANGLE, _RIGHT_ANGLE)
    v = centers[i] * float(centers[i] @ centers[j]) - centers[j]
    size = np.linalg.norm(v)
    return v / size * np.tan(angle) if size > 0 else np.zeros_like(v)


class Trainer:
    """What local and distributed training share. Subclasses give `_agreements(rows)` and `n_data`, `n_dims`."""

    centers: np.ndarray
    overlap_mat: np.ndarray
    n_data: int

    def __init__(self, n_bits: int, scale: float, update_parallel: bool, displace_parallel: bool, seed: int):
        if n_bits < 1:
            raise ValueError("the number of bits should be at least 1")
        self.n_bits, self.scale = n_bits, scale
        self.update_parallel, self.displace_parallel = update_parallel, displace_parallel
        self.rng = np.random.default_rng(seed)

    def _agreements(self, rows: np.ndarray) -> np.ndarray:
        """For each bit of `rows` and each bit: on how many data rows they agree."""
        raise NotImplementedError

    @property
    def sim_mat(self) -> np.ndarray:
        return similarity(self.overlap_mat, self.n_data)

    @property
    def sim_sums(self) -> np.ndarray:
        return self.sim_mat.sum(axis=1)

    @property
    def n_dims(self) -> int:
        return self.centers.shape[1]

    def refresh(self, rows: np.ndarray | None = None) -> None:
        rows = np.arange(self.n_bits) if rows is None else rows
        if rows.size == self.n_bits:
            self.overlap_mat = np.zeros((self.n_bits, self.n_bits), np.int64)
        got = self._agreements(rows)
        self.overlap_mat[rows] = got
        self.overlap_mat[:, rows] = got.T

    def step(self) -> None:
        sim = self.sim_mat
        if self.update_parallel:
            moved = np.arange(self.n_bits)
        else:
            pair = np.unravel_index(int(np.argmax(sim)), sim.shape)
            moved = np.array([pair[int(self.rng.integers(2))]])
        new = self.centers.copy()
        for i in moved:
            others = range(self.n_bits) if self.displace_parallel else [int(np.argmax(sim[i]))]
            push = sum((displacement(self.centers, self.overlap_mat, self.n_data, i, j, self.scale) for j in others if j != i), np.zeros(self.n_dims))
            row = self.centers[i] + push
            size = np.linalg.norm(row)
            if size > 0:
                new[i] = row / size
        self.centers = new
        self.refresh(moved)

    def run(self, n_steps: int) -> Trainer:
        for _ in range(n_steps):
            self.step()
        return self

    def encode(self, data: DataFrame, word_bits: int = 64, **names) -> DataFrame:
        return encode.encode(data, self.centers, word_bits, **names)

    def _init_ransac(self, x: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], pairs_per_bit: int) -> None:
        """Per bit, of some pair differences that whose worst agreement with the bits so far, over x, is nearest to 1/2."""
        chosen, bits = [], np.zeros((0, len(x)), np.float32)
        for _ in range(self.n_bits):
            best = None
            for a, b in islice(pairs, pairs_per_bit):
                c = a - b
                size = np.linalg.norm(c)
                if size == 0 or (best is not None and not len(bits)):
                    continue
                c = c / size
                sign = np.where(x @ c >= 0, 1, -1).astype(np.float32)
                worst = float(np.abs(bits.astype(np.float64) @ sign).max()) if len(bits) else 0.0  # twice the agreements less n
                if best is None or worst < best[0]:
                    best = (worst, c, sign)
            if best is None:  # only coincident points: any direction will do
                c = self.rng.standard_normal(x.shape[1])
                best = (0.0, c / np.linalg.norm(c), np.ones(len(x), np.float32))
            chosen.append(best[1])
            bits = np.vstack([bits, best[2]])
        self.centers = np.array(chosen)

    def _random_pairs(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while True:
            a, b = self.rng.choice(len(x), 2, replace=False) if len(x) > 1 else (0, 0)
            yield x[a], x[b]


class LocalTrainer(Trainer):
    """Over a matrix in memory (a bounded sample)."""

    def __init__(
        self,
        x: np.ndarray,
        n_bits: int,
        scale: float = 1.0,
        centers: np.ndarray | None = None,
        init_greedy: bool = False,
        init_ransac: bool = False,
        ransac_pairs_per_bit: int = 200,
        ransac_sub_sample: int = 2000,
        update_parallel: bool = False,
        displace_parallel: bool = False,
        seed: int = 0,
    ):
        super().__init__(n_bits, scale, update_parallel, displace_parallel, seed)
        self.x = np.asarray(x, np.float64)
        self.n_data = len(self.x)
        if centers is not None:
            self.centers = np.array(centers, np.float64)
        elif init_greedy or init_ransac:
            self.centers = np.zeros((n_bits, self.x.shape[1]))
        else:
            self.centers = self.x[self.rng.permutation(self.n_data)[np.arange(n_bits) % self.n_data]].copy()
        if init_greedy:
            self._init_greedy()
        elif init_ransac:
            some = self.x[self.rng.permutation(self.n_data)[: min(ransac_sub_sample, self.n_data)]]
            self._init_ransac(some, self._random_pairs(self.x), ransac_pairs_per_bit)
        self.refresh()

    def _signs(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.where(self.centers[rows] @ self.x.T >= 0, 1, -1).astype(np.float32)

    def refresh(self, rows: np.ndarray | None = None) -> None:
        if rows is None:
            self.signs = self._signs(np.arange(self.n_bits))
        else:
            self.signs[rows] = self._signs(rows)
        super().refresh(rows)

    def _agreements(self, rows: np.ndarray) -> np.ndarray:
        return ((self.n_data + np.rint(self.signs[rows].astype(np.float64) @ self.signs.T)) / 2).astype(np.int64)

    def _init_greedy(self, attempts: int = 20) -> None:
        """Per bit: of random points and their nearest by the code so far, the nearest pair gives the direction."""
        code = np.zeros((self.n_data, 0), np.uint8)
        for bit in range(self.n_bits):
            best = None
            for p1 in self.rng.integers(0, self.n_data, attempts):
                d = (code != code[p1]).sum(axis=1)
                d[p1] = self.n_bits + 1
                apart = np.abs(self.x - self.x[p1]).max(axis=1) > 0
                d = np.where(apart, d, self.n_bits + 1)  # coincident points give no direction
                p2 = int(np.argmin(d))
                if d[p2] <= self.n_bits and (best is None or d[p2] < best[0]):
                    best = (int(d[p2]), int(p1), p2)
                if best is not None and best[0] == 0:
                    break
            c = self.x[best[1]] - self.x[best[2]] if best else self.rng.standard_normal(self.x.shape[1])
            self.centers[bit] = c / np.linalg.norm(c)
            code = np.hstack([code, (self.x @ self.centers[bit] >= 0).astype(np.uint8)[:, None]])


class DistributedTrainer(Trainer):
    """Over a DataFrame: one scan per step, which returns counts for the moved bits only."""

    def __init__(
        self,
        data: DataFrame,
        n_bits: int,
        scale: float = 1.0,
        centers: np.ndarray | None = None,
        init_greedy: bool = False,
        init_ransac: bool = False,
        ransac_pairs_per_bit: int = 200,
        ransac_sub_sample: int = 2000,
        ransac_pool: int = 20_000,
        update_parallel: bool = False,
        displace_parallel: bool = False,
        seed: int = 0,
        data_id: str = "vec_id",
        embedding: str = "embedding",
    ):
        super().__init__(n_bits, scale, update_parallel, displace_parallel, seed)
        self.data = data.where(F.col(data_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(data_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        self.n_data = self.data.count()
        if not self.n_data:
            raise ValueError("no rows to train on")
        if centers is not None and not init_greedy and not init_ransac:
            self.centers = np.array(centers, np.float64)
        elif init_greedy:
            self._init_greedy(seed)
        elif init_ransac:
            # points of pairs are drawn from all rows, each once before any comes again; what the driver holds is bounded
            wanted = 2 * ransac_pairs_per_bit * n_bits
            pool = self._rows(min(wanted, ransac_pool), seed + 1)
            pairs = zip(pool[0::2], pool[1::2], strict=False) if len(pool) == wanted else self._random_pairs(pool)
            self._init_ransac(self._rows(min(ransac_sub_sample, self.n_data), seed), iter(pairs), ransac_pairs_per_bit)
        else:
            some = self._rows(min(n_bits, self.n_data), seed)
            self.centers = some[np.arange(n_bits) % len(some)]
        self.refresh()

    def _rows(self, n: int, seed: int) -> np.ndarray:
        drawn = sampling.draw(self.data, 0, n, seed).join(self.data, "vec_id").orderBy("draw")
        return np.array([r["v"] for r in drawn.collect()], np.float64)

    def _agreements(self, rows: np.ndarray) -> np.ndarray:
        spark = self.data.sparkSession
        shared = spark.sparkContext.broadcast((self.centers, rows))
        n_bits = self.n_bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, rows = shared.value
            total = np.zeros((len(rows), n_bits), np.int64)
            for batch in batches:
                x = as_matrix(batch.column("v"), np.float64)
                if len(x):
                    s = np.where(x @ centers.T >= 0, 1.0, -1.0)
                    total += ((len(x) + np.rint(s[:, rows].T @ s)) / 2).astype(np.int64)
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel()), "j": pa.array(j.ravel()), "n": pa.array(total.ravel())})

        got = self.data.select("v").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # moved bits x bits
        out = np.zeros((len(rows), self.n_bits), np.int64)
        for r in got:
            out[r["i"], r["j"]] = r["n"]
        return out

    def _init_greedy(self, seed: int, attempts: int = 20) -> None:
        self.centers = np.zeros((0, len(self.data.first()["v"])))
        for bit in range(self.n_bits):
            points = self._rows(min(attempts, self.n_data), seed * 1000 + bit)
            pair = nearest_by_code(self.data, points, self.centers)
            c = pair[0] - pair[1] if pair is not None else self.rng.standard_normal(points.shape[1])
            self.centers = np.vstack([self.centers, c / np.linalg.norm(c)])


def nearest_by_code(data: DataFrame, points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of some points and the other data rows, the pair of least code distance (ties: first point, smallest id)."""
    shared = data.sparkSession.sparkContext.broadcast((points, centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, centers = shared.value
        code = points @ centers.T >= 0
        for batch in batches:
            x = as_matrix(batch.column("v"), np.float64)
            if not len(x):
                continue
            mine = x @ centers.T >= 0
            d = (code[:, None, :] != mine[None, :, :]).sum(axis=2)
            same = np.abs(x[None] - points[:, None]).max(axis=2) == 0
            d = np.where(same, np.iinfo(np.int64).max, d)
            ids = np.asarray(batch.column("vec_id"))
            row = np.lexsort((ids, d[0])) if len(points) == 1 else None
            best = [int(row[0])] if row is not None else [int(np.lexsort((ids, dp))[0]) for dp in d]
            ok = [p for p, b in enumerate(best) if not same[p, b]]
            yield pa.RecordBatch.from_pydict({"d": pa.array([int(d[p, best[p]]) for p in ok], pa.int64()), "p": pa.array(ok, pa.int64()), "vec_id": pa.array([int(ids[best[p]]) for p in ok], pa.int64()), "v": pa.array([x[best[p]].tolist() for p in ok], pa.list_(pa.float64()))})

    best = data.mapInArrow(run, "d long, p long, vec_id long, v array<double>").agg(F.min(F.struct("d", "p", "vec_id", "v")).alias("m")).first()["m"]
    return None if best is None else (points[best["p"]], np.array(best["v"]))


class StochasticTrainer:
    """Local steps over seeded samples without replacement: a new sample every `its_per_sample` steps."""

    def __init__(
        self, data: DataFrame, sample_size: int, its_per_sample: int, n_bits: int, noise_std: float | None = None, seed: int = 0, data_id: str = "vec_id", embedding: str = "embedding", **options
    ):
        self.data = data.where(F.col(data_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(data_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        self.sample_size, self.its_per_sample, self.noise_std, self.seed = sample_size, its_per_sample, noise_std, seed
        self.n_samples, self._drawn, self._its = 0, 0, 0
        self.rng = np.random.default_rng(seed)
        self.inner = LocalTrainer(self._sample(), n_bits, seed=seed, **options)

    def _sample(self) -> np.ndarray:
        rows = sampling.draw(self.data, self._drawn, self.sample_size, self.seed).join(self.data, "vec_id").orderBy("draw").collect()  # sample_size rows
        self._drawn += self.sample_size
        self.n_samples += 1
        x = np.array([r["v"] for r in rows], np.float64)
        if not len(x):
            raise ValueError("no rows to train on")
        return x + self.rng.normal(0, self.noise_std, x.shape) if self.noise_std else x

    def step(self) -> None:
        if self._its >= self.its_per_sample:
            old = self.inner
            self.inner = LocalTrainer(self._sample(), old.n_bits, old.scale, old.centers, update_parallel=old.update_parallel, displace_parallel=old.displace_parallel, seed=self.seed + self.n_samples)
            self._its = 0
        self.inner.step()
        self._its += 1

    def run(self, n_steps: int) -> StochasticTrainer:
        for _ in range(n_steps):
            self.step()
        return self

    def encode(self, data: DataFrame, word_bits: int = 64, **names) -> DataFrame:
        return self.inner.encode(data, word_bits, **names)

    def __getattr__(self, name: str):
        """centers, overlap_mat, sim_mat, sim_sums, scale and so on are those of the current sample's trainer."""
        if name == "inner":
            raise AttributeError(name)
        return getattr(self.inner, name)


def overlap_stats(codes: DataFrame, n_bits: int, n_data: int, word_bits: int = 64, code: str = "code") -> DataFrame:
    """i, j, overlap, sim for every two bits: one scan, a matrix product for each batch, a matrix of counts from each task."""
    width = stored_bits(word_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_bits, n_bits), np.int64)
        for batch in batches:
            words = as_matrix(batch.column("code"), np.int64)
            if len(words):
                raw = words.astype(f"<u{width // 8}", casting="unsafe") if width < 64 else words
                s = np.unpackbits(np.ascontiguousarray(raw).view(np.uint8), axis=1, bitorder="little")[:, :n_bits].astype(np.float64) * 2 - 1
                total += ((len(s) + np.rint(s.T @ s)) / 2).astype(np.int64)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)), "n": pa.array(total.ravel())})

    counts = codes.where(F.col(code).isNotNull()).select(F.col(code).alias("code")).mapInArrow(run, "i int, j int, n long")
    overlap = F.sum("n").cast("long")
    return counts.where("i <> j").groupBy("i", "j").agg(overlap.alias("overlap"), F.abs(overlap / F.lit(float(n_data)) - 0.5).alias("sim"))


def sim_sums(stats: DataFrame) -> DataFrame:
    return stats.groupBy("i").agg(F.sum("sim").alias("sim_sum"))
