"""Queries of problem 4: noise in scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronry.llm.scans import noisy_lines, repaired, repaired_documents
from heronry.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return noisy_lines(table(spark, d, "parsed_pages")).distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repaired(table(spark, d, "parsed_pages"))


def p4_repaired_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same for whole texts: every version of every scanned document."""
    return repaired_documents(table(spark, d, "parsed_documents"), table(spark, d, "parsed_pages"))


QUERIES = {"p4_found": (p4_found, None), "p4_repaired": (p4_repaired, None), "p4_repaired_documents": (p4_repaired_documents, None)}
