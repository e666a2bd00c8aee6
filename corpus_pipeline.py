"""Five steps from raw documents to token ids; each is written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from periodica.llm import byte_bpe, decontamination, ngram_join, secret_scan, toxicity
from periodica.llm.common import lean_batches
from periodica.session import shared_dir


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    lean_batches(spark)
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each group of linked documents; other texts under its ids stay."""
    lean_batches(spark)
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    lean_batches(spark)
    return decontamination.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of secrets replaced by a mark."""
    return secret_scan.redact(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the bytes they decode to."""
    lean_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path), keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_scan_stage),
    ("byte-level BPE", byte_bpe_stage),
]

#: Tokenisation and learned scores can't be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex[:8]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
