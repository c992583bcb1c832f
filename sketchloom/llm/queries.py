"""The registered queries of the ten operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, langid, lines, mixing, quality, simhash, suffix, warc
from .common import held_out, table, work_dir


def quality_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id -> quality weight for mixing: labelled good 2, labelled bad 1/2 (repeated labels: the best)."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null")
    return labels.groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.when(F.col("q") > 0, 2.0).otherwise(0.5).alias("quality_weight"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    docs = docs.join(quality_weight(spark, sf_dir), "doc_id", "left")
    out = mixing.mix_sources(docs, F.col("size"), weight=F.col("quality_weight"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), learn=~held_out("id"))
    out = quality.score_quality(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"), F.octet_length(kept).cast("long").alias("kept_bytes"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_language(docs, learn=~held_out())
    out = langid.predict_language(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    out = warc.read_archive(spark, path, with_payload=False)
    return out.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"), "complete")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), is_query="id % 50 = 0", k=5)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).selectExpr("-1L as conv_id", f"stack(2, 0L, 'user', '{probe}', 1L, 'assistant', '{probe}') as (turn, role, text)")
    return chat.chat_digest(chat.read_chats(chat.format_chats(rows.unionByName(extra))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_quality, op3_decontaminate, op4_suffix_dedup, op5_line_dedup, op6_language, op7_simhash, op8_warc, op9_nearest, op10_chat_format)}
