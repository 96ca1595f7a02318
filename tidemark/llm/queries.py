"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, hnsw, hosts, infill, interactions, licenses, mixing, pii, quality, quotes, simhash, substrings, toxicity
from tidemark.llm.common import table


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.query(spark, table(spark, sf_dir, "conversations"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(spark, table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(spark, table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.query(spark, table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(spark, table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(spark, table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(spark, table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.query(spark, table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.query(spark, table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotes": op1_quotes,
    "op2_source_mix": op2_source_mix,
    "op3_licenses": op3_licenses,
    "op4_hnsw": op4_hnsw,
    "op5_quality": op5_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_substrings": op8_substrings,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_infill": op11_infill,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_trust": op13_url_trust,
}

ORACLE: dict[str, str] = {
    "op1_quotes": quotes.SQL,
    "op2_source_mix": mixing.SQL,
    "op11_infill": infill.SQL,
    "op12_filter_audit": interactions.SQL,
    "op13_url_trust": hosts.SQL,
}
