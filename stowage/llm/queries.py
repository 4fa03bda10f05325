"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hard_negatives, html_extract, media, minhash_dedup, mixing, oracle, quality, quality_classifier, secrets, suffix_dedup, toxicity, vector_codes
from .common import read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    return chat.window_digests(chat.windows(rows.unionByName(own), VOCABULARY, public_tokenizers.PATTERN))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_toxicity, op3_secret_scans, op4_html_extraction, op5_minhash_near_dedup,
        op6_byte_bpe, op7_chat_formatting, op8_suffix_array_dedup, op9_source_mixing, op10_media_columns,
        op11_quality_classifier, op12_vector_code_compression, op13_hard_negative_mining,
    )
}

#: SQL for those that it can express; the others are compared with brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_quality_rules": oracle.QUALITY,
    "op5_minhash_near_dedup": oracle.NEAR_DUPLICATES,
    "op8_suffix_array_dedup": oracle.SUFFIXES,
    "op12_vector_code_compression": oracle.VECTOR_CODES,
    "op13_hard_negative_mining": oracle.HARD_NEGATIVES,
}
