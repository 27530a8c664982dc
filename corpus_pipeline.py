"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Rejected documents go, one of each group of near copies stays, documents with benchmark passages
go, secrets are replaced, and sources are mixed to their target weights. All but the last stage
return the columns of documents; the last has source_size, target, copies and copy as well.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.llm.common import cut
from weft.llm.decontam import clean
from weft.llm.mixing import mixed
from weft.llm.neardup import one_of_each
from weft.llm.quality import accept
from weft.llm.secrets import redact


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier does not reject."""
    return accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group: runs of five words, similarity 0.8 or more."""
    return one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no benchmark item: runs of five words, a share of 0.8 or more."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets replaced."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it."""
    return mixed(docs)


STAGES = [("quality", classify), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secrets", secrets), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
