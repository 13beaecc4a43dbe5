"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cinderlens.llm import byte_bpe, byte_cnn, conversations, count_tree_join, katz, licenses, merkle, mixing, order_minhash, quality, simple8b, url_trust, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": lambda s, d: url_trust.filter_urls(_pages(s, d)),
    "op2_license_scans": lambda s, d: licenses.license_report(_documents(s, d)),
    "op3_quality_rules": lambda s, d: quality.quality_report(_documents(s, d)),
    "op4_document_fingerprints": lambda s, d: order_minhash.edit_report(_documents(s, d)),
    "op5_token_output": lambda s, d: simple8b.round_trip(_documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
    "op6_lm_scoring": lambda s, d: katz.score(_documents(s, d)),
    "op7_source_mixing": lambda s, d: mixing.mix(_documents(s, d)).select("doc_id", "size", "source_size", "target", "taken"),
    "op8_warc": lambda s, d: warc.capture_digest(_pages(s, d)),
    "op9_byte_bpe": lambda s, d: byte_bpe.token_digest(_documents(s, d), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    "op10_ngram_jaccard_join": lambda s, d: count_tree_join.near_copies(_documents(s, d)),
    "op11_conversation_repair": lambda s, d: conversations.damage_report(_conversations(s, d)),
    "op12_merkle_manifest": lambda s, d: merkle.manifest(_documents(s, d)),
    "op13_quality_classifier": lambda s, d: byte_cnn.quality_report(_documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
}

ORACLES: dict[str, str] = {"op8_warc": warc.ORACLE_SQL, "op11_conversation_repair": conversations.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
