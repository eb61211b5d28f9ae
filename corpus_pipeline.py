"""A training-corpus pipeline over ``documents``: language, exact copies, near copies, personal data, packing.

Each stage works on what its predecessor kept, written as Parquet and read again. In all stages a null text counts as empty,
rows that repeat an id with the same text share a decision, rows with a null id are judged by their text alone, further columns
go through as they are, and an empty table gives an empty one. Part of the subpackage ``touchline.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from touchline.llm import exact_dedup, langid, packing, pii, simhash
from touchline.llm.common import remove, scratch, table, temporary

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty, or no letter) go."""
    return langid.keep_identified(docs, langid.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the one with the smallest doc_id stays.

    SimHash fingerprints of five-word shingles within 4 bits, found with BK-trees, and what they can't see; all links have a
    five-word Jaccard similarity of 0.8 or more.
    """
    return simhash.drop_near_copies(docs, width=5, similarity=0.8, radius=4)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, TOKENIZER, weights=WEIGHTS)


#: Parameter: the weights of the residual tokens, documents and attention cost.
WEIGHTS = (1.0, 0.05, 0.05)

STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", pack)]

#: The language, personal-data and packing stages have no form in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; what a stage leaves is removed once the next one has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
