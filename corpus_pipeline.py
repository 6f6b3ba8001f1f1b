"""Corpus pipeline: documents in, packed training sequences out."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rewardlake.llm import langid, packing, pii, quality, simhash
from rewardlake.llm.common import load, spread, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the weak-label classifier rejects go."""
    return quality.accepted(spread(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents in none of the corpus languages go; ``lang`` becomes the language
    found."""
    return langid.accepted(spread(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each near-duplicate group the document with the smallest id stays."""
    return simhash.one_of_each(spread(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: found spans are replaced by their kind; ``n_chars`` follows the text."""
    return pii.redact(spread(docs), chars_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents as packed pieces, one row per piece, with their token ids."""
    return packing.pack_documents(spread(docs), public_tokenizers.path("word_bpe_49k.json"),
                                  with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

# Learned models, Hamming components and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written once and read again."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs), sf_dir)
    return docs
