"""The operators applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, chat, collocations, jaccard, langid, lm, mixing, positional, quality, substrings, token_files, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.pair_neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_collocations": op11_collocations, "op12_token_alignment": op12_token_alignment, "op13_byte_bpe": op13_byte_bpe, "op10_lm_score": op10_lm_score, "op1_warc": op1_warc, "op2_language_id": op2_language_id, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_source_mix": op4_source_mix, "op5_token_files": op5_token_files, "op6_substring_dedup": op6_substring_dedup, "op7_preference_chat": op7_preference_chat, "op8_quality_rules": op8_quality_rules, "op9_decontaminate": op9_decontaminate}

ORACLE_SQL = {
    "op7_preference_chat": chat.ORACLE,
    "op4_source_mix": mixing.ORACLE,
    "op1_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                  strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100
                THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN origin = page_id THEN NULL ELSE origin END AS refers_to
FROM f""",
}
