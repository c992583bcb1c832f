"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, work_dir, write_out


def _kept(df: DataFrame, paths: list[str]) -> DataFrame:
    """Write `df` to the shared folder: a join then deals it out itself and can split a hub's rows."""
    paths.append(work_dir(df.sparkSession))
    return write_out(df, paths[-1])


def _round(edges: DataFrame, paths: list[str]) -> DataFrame:
    """One large-star and one small-star step; minima are aggregated first, so a hub never meets in one task."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), paths)
    large = _kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), paths)
    least = _kept(large.groupBy("a").agg(F.min("b").alias("m")), paths)
    small = large.join(least, "a")
    moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.select("a", F.col("m").alias("b")).union(moved).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`a`, `b` (long node ids, any direction) -> one row (a, b) for each node that is not its component's smallest.

    Rounds go on until the edge set stays the same; every round is written to the shared folder and the one before
    is removed. The number of rounds is logarithmic in the longest path.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    seen, old = None, []
    for _ in range(max_rounds):
        paths: list[str] = []
        now = _kept(now, paths)
        # exact count plus two order-free sums tell whether the set changed
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.hash("b", "a").cast("long")), F.lit(0))).first())
        for p in old:
            drop_path(spark, p)
        if mark == seen or mark[0] == 0:
            return now
        seen, old = mark, paths
        now = _round(now, paths)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
