"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from martloom.llm import chat, decontam, lexical, mixing, periodic, prefix_counts, quality, rules, secret_scan, simhash, substrings, tokens, urls
from martloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clustered(read(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_documents(tokens.write_shards(read(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("__h1", "__h2")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(read(spark, sf_dir, "documents"), digest=True)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read(spark, sf_dir, "conversations"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.report(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_url_filter, op3_quality_trees, op4_secret_scan, op5_quality_rules, op6_simhash, op7_token_shards,
        op8_decontamination, op9_substring_dedup, op10_chat_format,
        op11_lexical_search, op12_prefix_counts, op13_periodic_runs,
    )
}

SQL: dict[str, str] = {
    "op1_source_mix": mixing.SQL, "op8_decontamination": decontam.SQL, "op9_substring_dedup": substrings.SQL, "op10_chat_format": chat.SQL,
    "op11_lexical_search": lexical.SQL,
}
