"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from stowage.llm import bpe, minhash_dedup, mixing, secrets, toxicity
from stowage.llm.common import cut, drop, read, with_keys

#: Near copies in the corpus are pairs at a Jaccard similarity of 0.8 or more; op5's query has its own 0.85.
NEAR_PERCENT = 80
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model predicts toxic go; it learns from the labelled rows of docs."""
    return toxicity.split_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id; repeated rows of it are one document, rows without a doc_id are each one."""
    keyed, _ = with_keys(docs)
    found = minhash_dedup.near_duplicates(keyed.select(F.col("_row_key").alias("doc_id"), "text"), NEAR_PERCENT)
    kept = found.where("kept").select(F.col("doc_id").alias("_row_key")).distinct()
    return keyed.join(kept, "_row_key", "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mask; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, which encode gives back as slot and place; every document stays."""
    return mixing.in_mix_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left, with slot and place, in the order of the mix."""
    options = mixing.mix_options(docs)
    if options is None:
        raise ValueError("the documents aren't mixed: no stage says in which order they go")
    digests = cut(bpe.encode_digests(docs, VOCABULARY, public_tokenizers.PATTERN))  # a sort reads its input twice
    placed = digests.join(mixing.order_of(docs, **options), F.col("doc_id").eqNullSafe(F.col("_mix_doc"))).drop("_mix_doc")
    return placed.orderBy("slot", "place")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL has neither the toxicity model nor the tokenizer's merges; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if i:  # a table of the stage before, which nothing reads any more
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
