"""Train sketches on samples of a vector table, encode it, and search it: demo.py TABLE.parquet [STEPS]."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sketchloom.plans.api import SketchSearch  # noqa: E402
from sketchloom.sources import vectors as source  # noqa: E402


def main(path: str, steps: int = 500) -> None:
    spark = SparkSession.builder.appName("sketch search").getOrCreate()
    s = SketchSearch(spark)
    data = source.read_vectors(spark, path)
    trainer = s.stochastic_trainer(data, sample_size=2000, its_per_sample=128, n_bits=64, scale=0.1, seed=1)
    before = trainer.sim_mat.mean()
    trainer.run(steps)
    print(f"mean similarity of bits: {before:.4f} before, {trainer.sim_mat.mean():.4f} after {steps} steps")
    codes = trainer.encode(data, keep=["vec_id"])
    queries = data.where("vec_id % 100 = 0")
    found = s.query(data, codes, queries, trainer.encode(queries, keep=["vec_id"]), k=10, n=100)
    found.orderBy("query_id", "rank").show(20)
    print("recall of the 10 best among 100:", s.recall(s.k_largest_dot(data, queries, 10), found))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
