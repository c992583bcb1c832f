"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / weight, from a hash of its id; within its source the documents
are sorted by key and their sizes prefix-summed. A source takes its complete epochs first (every document once per
epoch), then the documents at the head of the key order until what remains of its target is filled.

The sort is one range partitioning by (source, key), written to the shared folder with its partition number; prefix
sums are then sums per (source, partition) plus a window inside each partition, so no source, however large, meets in
one task, and rows that share an id, and so a key, are split too. The sources themselves, which may be many, get their
ranks and running sums in the same way. Only a row per partition is ever gathered.

Defined results: null text or size counts 0 words and such a document is taken 0 words; null source is a source of
its own, last in order; null id draws the key of the text "null"; equal keys (repeated rows) are ordered by id, then
size, and which of two equal rows comes first does not change the result; a very long text is counted whole; columns of
any name beside those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sums_before

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash of seed and id: smaller keys come first."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """Targets of sources: `source`, `source_size` -> adds `weight` and `target`.

    Weights repeat over the sources in code-point order, null last. `share` times all sizes is dealt by weight; a
    target stops at `limit` times its source's size, and the excess is reshared by weight until no target is above.
    Sources are capped in the order of size / weight, so the fixed point is one ordered pass: a source is capped if
    the level that the sources from it on would get is at or above its own cap.
    """
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    number = sums_before(sizes, by_name, {"number": F.lit(1)})
    w = number.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * limit
    w = sums_before(w, [cap / F.col("weight"), *by_name], {"cap_before": cap, "weight_before": F.col("weight")})
    all_ = w.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = float(all_["size"] or 0) * share
    level = cap / F.col("weight") * (F.lit(all_["weight"] or 0.0) - F.col("weight_before"))
    w = materialize(w.withColumn("capped", F.lit(budget) - F.col("cap_before") >= level))
    fixed = w.agg(F.sum(F.when(F.col("capped"), cap)).alias("cap"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("free")).first()
    rest, free = budget - float(fixed["cap"] or 0), fixed["free"] or 1.0
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * F.lit(rest) / F.lit(free))
    return w.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix_sources(
    docs: DataFrame,
    size: Column,
    doc_id: str = "doc_id",
    source: str = "source",
    weight: Column | None = None,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs, taken (words taken, repeats counted), copies.

    `weight` is the document's quality weight (null or not above 0: 1). The document that crosses the end of the
    budget is taken if that brings the source nearer to its target.
    """
    spark = docs.sparkSession
    heavy = F.coalesce(weight, F.lit(1.0)).cast("double") if weight is not None else F.lit(1.0)
    heavy = F.when(heavy > 0, heavy).otherwise(1.0)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), heavy.alias("w"))
    base = base.withColumn("key", exponential_key(F.col("doc_id"), F.col("w"), seed)).withColumn("row", F.monotonically_increasing_id())
    base = materialize(base.drop("w"))  # texts are read once
    targets = materialize(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartitionByRange(parts, F.col("source"), F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt)  # fixes the bounds of the ranges
    sums = dealt.groupBy("source", "part").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ahead = ahead.join(targets.select(F.col("source").alias("s2"), "source_size", "target"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("ahead") + F.col("inside") + F.col("size") / 2 <= F.col("rest")) & (F.col("size") > 0)
    return (
        rows.withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .withColumn("copies", F.col("epochs") + extra.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "epochs", "key")
    )
