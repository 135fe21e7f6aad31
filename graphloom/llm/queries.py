"""Registered queries of the problems on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import doc_pairs, leakage, mixing, source_check, truncation
from graphloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return source_check.check_files(table(spark, folder, "src_files")).filter(~F.col("valid")).select("file_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return source_check.invalid_rates(source_check.check_files(table(spark, folder, "src_files")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return doc_pairs.documented_functions(table(spark, folder, "src_files")).select("file_id", "def_line", "name")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, folder), table(spark, folder, "eval_items"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.judge_documents(table(spark, folder, "documents")).filter("truncated").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(truncation.judge_documents(table(spark, folder, "documents")))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_rates)}
SQL: dict[str, str] = {}
