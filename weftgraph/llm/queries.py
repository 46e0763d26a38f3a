"""The queries of the corpus operators: thin digests of what the operators give, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, decontam, langid, licenses, lines, minhash, mpeg, quality, secrets, suffix

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(common.table(spark, sf_dir, "documents"), runs=True)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fitted(docs.where(~langid.held_out()))
    return langid.identified(docs, model, langid.held_out().alias("held_out"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(common.table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(common.table(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(common.table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.grouped(common.table(spark, sf_dir, "documents"), percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    weights, _ = quality.fitted(docs)
    return quality.scored(docs, weights)


def op10_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_lines, op3_langid, op4_decontam, op5_secrets, op6_licenses, op7_suffix, op8_minhash, op9_quality, op10_mpeg)}


def oracle_sql() -> dict[str, str]:
    return {}
