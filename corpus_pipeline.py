"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's input.

Every stage works on all that its predecessor kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkburst.llm import decontamination, language, ngram_join, packing, privacy
from sparkburst.llm.tables import read, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose language the model rejects: no letter in them, or none of its languages likely."""
    return language.accepted(docs, language.train(docs))


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, that of the smallest doc_id, of each group of near copies: five-word shingles, similarity 0.8."""
    return ngram_join.representatives(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents into which an item of ``benchmark`` leaks."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts; keeps every document."""
    return privacy.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_dedup),
    ("decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", pack),
]
#: Trained models and tokenizers are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
