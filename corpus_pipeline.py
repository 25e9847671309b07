"""A corpus pipeline of five stages: quality, near copies, benchmark passages, mixture, token blocks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontaminate as leaks
from touchline.llm import jaccard_join, mixing, quality, token_blocks
from touchline.llm.common import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from ``labels`` of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.where(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    weights = quality.train_quality(docs, known)
    return quality.score_quality(docs, weights).where("score >= 0.7").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of similar ones (five words, 0.8)."""
    return jaccard_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight in the mixture asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what reading them back gives of each."""
    return token_blocks.token_blocks(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_copies", near_copies), ("decontaminate", benchmark_passages), ("mixture", mixture), ("token_blocks", tokens)]

#: A learnt model, hashes and files: no SQL gives these rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result a table that the next reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
