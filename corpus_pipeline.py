"""The corpus pipeline: quality, toxicity, near-duplicates, decontamination, encoding.

Each stage takes all documents that the one before it kept. Classifiers learn from the
labels of documents that reached their stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanthorn.llm import bpe, decontam, dedup, quality, toxicity
from lanthorn.llm._store import written
from lanthorn.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return dedup.keep_first(docs, p=dedup.MinHash(shingle=5, percent=80))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item to four fifths go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding", encoding_stage),
]

#: SQL can't express the stages; tests hold them against plain versions or, for classifiers, the operators' own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
