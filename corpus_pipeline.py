"""Corpus pipeline: quality classifier, line dedup, near-duplicate removal, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import decontaminate, jaccard, lines, mixing, quality
from sketchloom.llm.common import UID, drop_path, held_out, materialize, table, without, work_dir
from sketchloom.llm.queries import quality_weight


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 1/2) go."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), learn=~held_out("id"))
    scored = quality.score_quality(docs, model, keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for those in the template's first document; n_chars follows the text.

    A long passage needs as many documents as any line here: what only a few share are mostly copies, which the next
    stage takes out whole. Cut by this stage, their remains would no longer be found alike.
    """
    tree = lines.TemplateTree(long_docs=lines.TemplateTree.min_docs)
    out = lines.drop_recurring_lines(docs, keep_first=True, tree=tree)
    n_chars = F.when(F.col(out.columns[-1]) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, or of equal rows any one.

    Groups follow all pairs of texts whose sets of five-word shingles have similarity 0.8 or more: candidates share a
    shingle of their prefixes and lie near by 512-bit fingerprints, and the sets themselves decide; see `jaccard`.
    """
    rows = materialize(docs.withColumn(UID, F.monotonically_increasing_id()))
    groups = materialize(jaccard.similar_groups(rows, doc_id=UID))
    # the representative of a group is the row with its smallest doc_id; the others go
    members = groups.select(F.col("id").alias("u"), "component_id").join(rows.select(F.col(UID).alias("u"), "doc_id"), "u")
    members = materialize(members)  # tables on both sides of the join below, so that the rows of a large group can be split
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "u")
    stay = members.groupBy("component_id").agg(F.min_by("u", order).alias("u"), F.count("*").alias("n"))
    stay = materialize(stay.where("n > 1"))
    shared = members.join(stay.select("component_id", F.col("u").alias("stays")), "component_id")
    return without(rows, UID, materialize(shared.where("u <> stays").select("u"))).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words lie in benchmark windows go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns, with_spans=False)
    return found.where(~decontaminate.is_contaminated()).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document that is taken at all, with its copies and words taken."""
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mix = mixing.mix_sources(sized.join(quality_weight(spark, sf_dir), "doc_id", "left"), F.col("size"), weight=F.col("quality_weight"))
    return mix.where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the fingerprints are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet and reread as the next one's input."""
    docs, old = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = work_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old:
            drop_path(spark, old)
        old = path
    return docs
