"""Queries of problem 6: evaluation items inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.leakage import leaks, without_leaks
from heronry.tables import table


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "case_id", ["question", "expected_answer"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), "case_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items: in how many documents, and how."""
    return _leaks(spark, d).groupBy("case_id").agg(F.count("*").alias("n_docs"), F.sum((F.col("how") == "run").cast("int")).alias("n_runs"), F.max("length").alias("longest"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the passages of test items that it leaks, and where these were."""
    return without_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "case_id", ["question", "expected_answer"]).withColumnRenamed("id", "doc_id")


QUERIES = {"p6_found": (p6_found, None), "p6_items": (p6_items, None), "p6_clean": (p6_clean, None)}
