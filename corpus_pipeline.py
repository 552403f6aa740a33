"""A training-corpus pipeline: toxic documents, near copies and test passages go, sources are mixed, ids are written.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.decontamination import decontaminated
from corpusforge.llm.mixing import mixed_documents
from corpusforge.llm.near_dedup import deduplicated
from corpusforge.llm.token_files import token_files
from corpusforge.llm.toxicity import clean_documents
from corpusforge.session import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on those with labels, doesn't reject."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest id."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of any benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight says."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens and checksum of every copy."""
    return token_files(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing),
          ("tokens", tokens)]

#: A trained classifier, near-duplicate components and the tokenizer are beyond SQL: tests/llm holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
