"""The numbered queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.llm import chat, jaccard, knn, langid, line_dedup, mixing, packing, quality, source_audit, spelling, token_counts, toxicity, warc
from missiva.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("cleaned", "row_number")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), special=True)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, text = chat.PROBE
    probe = spark.range(2).select(
        F.lit(conv_id).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return chat.digests(chat.format_chats(turns.unionByName(probe)))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("node", "comp", "text_hash")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_mix_sources,
        op3_line_dedup,
        op4_packing,
        op5_chat_format,
        op6_exact_top_k,
        op7_warc,
        op8_language_id,
        op9_toxicity,
        op10_jaccard_join,
        op11_token_counts,
        op12_spelling_variants,
        op13_source_audit,
    )
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_chat_format": chat.ORACLE_SQL,
    "op6_exact_top_k": knn.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op10_jaccard_join": jaccard.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_source_audit": source_audit.ORACLE_SQL,
}
