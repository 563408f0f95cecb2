"""Corpus pipeline: stages over `documents`, each a DataFrame written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coverlens.llm import jaccard_join, language_id, packing, quality_rules
from coverlens.llm.common import DOCUMENT_COLUMNS
from coverlens.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.keep_good(docs.select(*DOCUMENT_COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a known language, by a model of the labelled ones among them."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return language_id.keep_known(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id."""
    return jaccard_join.keep_first(docs.select(*DOCUMENT_COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in training sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("jaccard_join", near_duplicates), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; each stage's rows are written below the shared checkpoint folder and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
