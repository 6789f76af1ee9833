"""Queries of the operators of this folder over the tables in sf_dir, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, flac, imatch, importance, jaccard, language, licences, manifest, mixing, pii, quality, risk, toxicity
from tidemark.llm.common import documents, table

#: The rank file and the pattern that op8 and the pipeline encode by.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), 4, 85, 100)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), language.fit(documents(spark, sf_dir)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.spans(docs, pii.fit(docs))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), RANKS, PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.result(documents(spark, sf_dir))


def op11_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_imatch, op2_ngram_jaccard, op3_licences, op4_flac, op5_language, op6_toxicity, op7_pii, op8_byte_bpe, op9_quality, op10_mixing, op11_risk_rules, op12_merkle, op13_importance)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_imatch": imatch.SQL, "op11_risk_rules": risk.SQL, "op12_merkle": manifest.SQL, "op13_importance": importance.SQL}
