"""Queries of problem 8: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.abuse import THRESHOLD, fitted, score
from heronry.llm.mixing import source_name
from heronry.tables import table


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    net = fitted(docs, "doc_id", "text", table(spark, d, "moderation_labels"))
    return score(docs, "doc_id", "text", net).drop("text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p8_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return (
        p8_scores(spark, d)
        .groupBy(F.coalesce(source_name(F.col("source")), F.lit("unknown")).alias("source"))
        .agg(F.count("*").alias("docs"), F.sum((F.col("score") >= THRESHOLD).cast("long")).alias("found"), F.round(F.avg((F.col("score") >= THRESHOLD).cast("double")), 6).alias("rate"))
    )


QUERIES = {"p8_found": (p8_found, None), "p8_scores": (p8_scores, None), "p8_source_rates": (p8_source_rates, None)}
