"""Queries of problem 3: personal information in chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.privacy import Own, entities, sanitise
from heronry.tables import staged, table


#: The mailboxes and the hotline of the shop whose messages these are.
SHOP = Own(("larkmoor.example",), r"(?<!\d)400[- .]?\d{3}[- .]?\d{2,4}(?!\d)")


def _found(spark: SparkSession, d: str) -> DataFrame:
    return entities(table(spark, d, "chat_messages"), "message_id", "message", SHOP)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select(F.col("id").alias("message_id"), "kind").distinct()


def p3_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Every message with typed placeholders, and how many there are."""
    found = staged(_found(spark, d), "entities")
    return sanitise(table(spark, d, "chat_messages"), "message_id", "message", found).withColumnRenamed("id", "message_id")


QUERIES = {"p3_found": (p3_found, None), "p3_sanitised": (p3_sanitised, None)}
