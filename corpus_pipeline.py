"""From raw documents to token ids: five stages, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, jaccard, langid, toxicity, unigram
from foliospark.llm.common import crc_part, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; learned from the labels whose crc32(doc_id) mod 5 is not 0."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"), train=crc_part("doc_id", 5) != 0)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go; learned from the documents whose crc32(doc_id) mod 4 is not 2."""
    return langid.in_known_language(docs, train=crc_part("doc_id", 4) != 2)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingle similarity 0.8 connect, the one with the least doc_id stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's 5-word shingles go."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again."""
    return unigram.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language id", keep_known_languages),
    ("near duplicates", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("token encoding", encode_tokens),
]

#: The classifiers and the encoder have no SQL; tests hold the operators that the stages call against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each on all that the stage before it kept and wrote."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
