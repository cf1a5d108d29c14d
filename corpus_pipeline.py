"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokens.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last keep the columns of `docs`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinseek.llm import byte_bpe, exact_dedup, language_id, simhash_dedup, source_mixing
from twinseek.session import materialize

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# Share of the tokens of the deduplicated corpus that the mixture has.
MIX_SHARE = (9, 10)
# An epoch beyond the first would bring copies back into a corpus that has just been deduplicated.
MIX_EPOCHS = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled part of `docs`; documents that the model rejects go."""
    return language_id.not_rejected(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected for the target weights of domains, languages and sources."""
    return source_mixing.mix(docs, share=MIX_SHARE, max_epochs=MIX_EPOCHS, carry=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 of every document, and its token ids."""
    coded = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE", tokens),
]
# Trained predictions and byte-pair merges cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "pipeline")
    return docs
