"""Registered queries of the training-text operators, and SQL for those that SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import read_table as t
from ..runtime import stage
from . import bpe, handwritten, leakage, pii


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(t(spark, d, "source_files")).select("rel")


def p1_symbols(spark: SparkSession, d: str) -> DataFrame:
    found = stage(handwritten.not_handwritten(t(spark, d, "source_files")), "not-handwritten")
    return handwritten.handwritten_symbols(t(spark, d, "symbols"), found)


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = handwritten.not_handwritten(t(spark, d, "source_files"))
    return handwritten.by_directory(found, t(spark, d, "exclude_dirs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return bpe.encode(docs, docs["doc_id"], docs["text"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(t(spark, d, "documents"), t(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    docs, items = t(spark, d, "documents"), t(spark, d, "eval_items")
    return leakage.leak_report(leakage.leaks(docs, items), docs, items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal(t(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_symbols, p1_reasons, p6_ids, p7_found, p7_report, p8_found, p8_redacted)}
SQL: dict[str, str] = {}
