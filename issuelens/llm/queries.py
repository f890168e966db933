"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from issuelens.llm import (
    bpe, divergence, embedding_dedup, line_dedup, minhash_dedup, oracles, packing, quality, ranked_search,
    reply_chat, secret_scan, substring_dedup, suffix_dedup, topk,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(_table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.byte_digests(_table(spark, sf_dir, "documents"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.word_digests(_table(spark, sf_dir, "documents"))


def op9_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.group_rows(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(_table(spark, sf_dir, "documents"))


def op11_reply_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_chat.conversation_digests(_table(spark, sf_dir, "conversations"))


def op12_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_quality_classifier, op3_line_dedup, op4_byte_bpe, op5_binary_packing,
    op6_suffix_dedup, op7_pivot_topk, op8_substring_dedup, op9_chosen_path_dedup, op10_secret_scan,
    op11_reply_chat, op12_shared_search, op13_source_audit,
)}

LLM_ORACLES = {
    "op1_embedding_dedup": oracles.EMBEDDING_LINKS,
    "op3_line_dedup": oracles.LINES,
    "op7_pivot_topk": oracles.TOP_K,
    "op8_substring_dedup": oracles.WORD_WINDOWS,
    "op9_chosen_path_dedup": oracles.SHINGLE_GROUPS,
    "op11_reply_chat": oracles.CONVERSATIONS,
    "op12_shared_search": oracles.RANKED_ITEMS,
    "op13_source_audit": oracles.DIVERGENCE,
}
