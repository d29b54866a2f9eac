"""The corpus pipeline: stages over ``documents``, each one of the package's operators.

Each stage works on all rows that the one before kept; all but the last return the
columns of ``documents``. Null texts are rejected by the first stage, and an empty table
stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontaminate, language_id, minhash_dedup, mixing, pii
from feedloom.llm.common import small_batches, stored, table

#: A document stays if its language is found with at least this score. Two families of two
#: languages give 0.25 to a text that says nothing; on held-out rows all that were right had more.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters go."""
    small_batches(spark)
    return language_id.identify(docs, language_id.train(docs), keep=LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    small_batches(spark)
    return minhash_dedup.first_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    small_batches(spark)
    return pii.mask_pii(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: how many of its words the mix takes, and its source's target."""
    mix = mixing.mixture(docs)
    return mix.taken(mix.written(docs)).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


STAGES = [
    ("language", known_language),
    ("near_dedup", near_dedup),
    ("decontaminate", clean_of_benchmark),
    ("pii", masked_pii),
    ("mix", mixed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each is stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
