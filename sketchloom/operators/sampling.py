"""Sampling without replacement by epochs: every id once per epoch, in a seeded pseudo-random order.

The order of an epoch is that of a 52-bit number from the MD5 digest of "seed:epoch:id", then of the id. Ids are dealt
to buckets by the number's top bits, which is uniform, so a position is the count of the buckets before plus a rank
inside the bucket. The number of buckets grows with the table, so a bucket stays at some ten thousand rows, and a draw
ranks only the buckets that its positions lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 52


def epoch_key(data_id: Column, seed: int, epoch: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), data_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def bucket_bits(n: int, rows: int = 10_000) -> int:
    """How many bits number the buckets of n rows: buckets of about `rows`, a million of them at most."""
    return min(20, max(0, (max(1, n) // rows).bit_length()))


def _buckets(data: DataFrame, seed: int, epoch: int, data_id: str, bits: int) -> DataFrame:
    keyed = data.where(F.col(data_id).isNotNull()).select(F.col(data_id).alias("vec_id"), epoch_key(F.col(data_id), seed, epoch).alias("key"))
    return keyed.withColumn("bucket", F.shiftrightunsigned("key", KEY_BITS - bits))


def epoch_ranks(data: DataFrame, seed: int, epoch: int, data_id: str = "vec_id", start: int = 0, stop: int | None = None) -> DataFrame:
    """vec_id and its 0-based position in the epoch's order, for positions start .. stop - 1 (default: all)."""
    spark, bits = data.sparkSession, bucket_bits(data.count())
    keyed = _buckets(data, seed, epoch, data_id, bits)
    ahead, rows = 0, []
    for r in keyed.groupBy("bucket").count().orderBy("bucket").collect():  # 2 ** bits rows
        if ahead + r["count"] > start and (stop is None or ahead < stop):
            rows.append((r["bucket"], ahead))
        ahead += r["count"]
    if not rows:
        return keyed.where(F.lit(False)).select("vec_id", F.lit(0).cast("long").alias("position"))
    some = keyed.where(F.col("bucket").between(rows[0][0], rows[-1][0]))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "vec_id"))
    ranked = some.withColumn("inside", inside).join(spark.createDataFrame(rows, "bucket long, ahead long"), "bucket")
    ranked = ranked.select("vec_id", (F.col("ahead") + F.col("inside") - 1).alias("position")).where(F.col("position") >= start)
    return ranked if stop is None else ranked.where(F.col("position") < stop)


def draw(data: DataFrame, start: int, count: int, seed: int, data_id: str = "vec_id") -> DataFrame:
    """Draws `start` .. `start + count - 1` of the endless sequence of epochs: draw, vec_id."""
    n = data.where(F.col(data_id).isNotNull()).count()
    out = None
    epoch = start // n if n else 0
    while n and epoch * n < start + count:
        part = epoch_ranks(data, seed, epoch, data_id, max(0, start - epoch * n), min(n, start + count - epoch * n))
        part = part.select((F.col("position") + epoch * n).alias("draw"), "vec_id")
        out = part if out is None else out.unionByName(part)
        epoch += 1
    return out if out is not None else data.where(F.lit(False)).select(F.lit(0).cast("long").alias("draw"), F.col(data_id).alias("vec_id"))
