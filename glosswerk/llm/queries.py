"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glosswerk.llm import bpe, langid, lexical, lines, mixing, neardup, quality, sharding, substrings, suffixes, vectors, whitening, wordbpe
from glosswerk.llm.shared import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), limit=sharding.QUERY_LIMIT)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digests(read(spark, sf_dir, "documents"))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digests(read(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digests(read(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_minhash_near_dedup, op4_byte_bpe, op5_line_dedup, op6_language_id, op7_multi_index_hashing, op8_quality_rules, op9_mixing, op10_suffix_dedup, op11_word_bpe, op12_embedding_whitening, op13_lexical_search)
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substrings.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op3_minhash_near_dedup": neardup.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
