"""From raw documents to token ids: quality classifier, exact and near de-duplication, source mixing, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.llm.exact_dedup import exact_dedup
from stratalith.llm.mixing import mixed_documents
from stratalith.llm.near_dedup import near_dedup
from stratalith.llm.quality_classifier import good_documents
from stratalith.llm.sentencepiece_codec import encoded
from stratalith.llm.storage import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the one with the smallest id."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document of the mix."""
    return encoded(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixing), ("sentencepiece", tokens)]

#: The classifier, the samples and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
