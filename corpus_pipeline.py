"""A corpus pipeline of five stages, each of which applies one operator to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir), docs having the columns of the table
documents. The first four return rows of docs with those columns; the last returns
doc_id, n_tokens and digests of the ids and of the bytes that they decode to.
Between stages the rows are written as Parquet and read again.

An empty table gives an empty one at every stage. Null and empty texts are judged like
any other by the classifier, and pass the other stages as they are. Rows that repeat a
doc_id, or have none, are rows of their own; of equal or similar texts one row stays.
Further columns are carried along.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import bpe, common, decontaminate, near, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Labels belong to the corpus; the model is learned from those of docs."""
    return quality.keep(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: five words, similarity 0.8."""
    return near.dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by [SECRET]."""
    return secrets.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted and told by digests; a null or empty text has none."""
    return bpe.encode_documents(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secrets_stage),
    ("encode", encode_stage),
]

#: Fitted models and similarity components aren't expressible; tests hold run() against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return posixpath.join(common.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
