"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from attrition.llm.byte_bpe import encode_documents
from attrition.llm.chat_format import format_conversations
from attrition.llm.common import read
from attrition.llm.exact_dedup import exact_duplicates
from attrition.llm.language_id import identify
from attrition.llm.lexical_search import ranked_search
from attrition.llm.line_dedup import dedup_lines, text_digest
from attrition.llm.merkle_manifest import manifest
from attrition.llm.packing import pack_documents
from attrition.llm.pii_semicrf import find_spans
from attrition.llm.quality_rules import quality_rules
from attrition.llm.simhash_golay import near_duplicates
from attrition.llm.sql import ORACLES as SQL
from attrition.llm.token_counts import count_tokens
from attrition.llm.topk_search import top_k


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


def op2_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), output="digest")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), report="n_lines_removed")
    return kept.select("doc_id", "n_lines_removed", F.length("text").alias("n_chars"),
                       text_digest("text").alias("text_sha256"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), keep_ids=False)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(read(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("n_bases")


REGISTRY = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": op1_token_counts,
    "op2_pii_semicrf": op2_pii_semicrf,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_topk_search": op6_topk_search,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

#: DuckDB SQL where SQL can express the operator.
ORACLES: dict[str, str] = dict(SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
