"""A corpus from documents: language, near duplicates, personal data, mixture, sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is stored before the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill import core
from leafmill.llm import crf_pii, langid, mixing, ngram_join, packing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by compression; those that it rejects go. The label column is not changed."""
    return langid.accepted(docs, langid.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: words 5-grams at a Jaccard similarity of 0.8."""
    return ngram_join.representatives(docs, n=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return crf_pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source take it."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Compression, CRF decoding and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = core.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
