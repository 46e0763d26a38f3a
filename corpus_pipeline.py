"""A training-data pipeline over the corpus operators: filter by quality, cut repeated lines, drop near copies and
benchmark text, encode. Every stage works on all that its predecessor kept; the first four return the table's columns.

Nulls: a document with a null text or key goes through all stages like any other and is encoded to no ids. Empty texts
stay, also those that a stage empties. Rows that are repeated whole stay or go together. Texts of any length are read
whole, and columns of any name pass through, but for token_ids and n_tokens, which the last stage replaces. Ties: of a
group of copies the smallest doc_id stays. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph import work
from weftgraph.llm import bpe, common, decontam, lines, minhash, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's input, does not reject."""
    weights, _ = quality.fitted(docs)
    return quality.filtered(docs, weights)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines and runs of lines that occurred earlier are cut from their texts, and n_chars follows."""
    cut = lines.deduplicated(docs, runs=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more."""
    return minhash.deduplicated(docs, percent=80, size=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids and n_tokens; decoding is verified on the way."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_filter), ("lines", line_dedup), ("minhash", near_dedup), ("decontam", decontaminate), ("bpe", encode)]

#: Near-duplicate components, learned weights and byte pairs have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each result written to the shared folder and read again.

    What a stage stores on its way, and the result before it, are deleted when its own result is written.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with work.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            work.removed(spark, before)
        before = out
    return docs
