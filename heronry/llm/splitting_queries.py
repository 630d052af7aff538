"""Queries of problem 5: oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.splitting import split_oversized
from heronry.tables import table


def _items(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str, kind: str, item_id, text: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(kind).alias("item_kind"), item_id.alias("item_id"), F.col(text).alias("text"))

    version = F.concat(F.col("doc_id"), F.lit(":"), F.col("doc_version").cast("string"))
    return (
        part("child_chunks", "child", F.col("child_id"), "content")
        .unionByName(part("parent_chunks", "parent", F.col("parent_id"), "content"))
        .unionByName(part("parsed_documents", "raw_text", version, "raw_text"))
    )


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_items(spark, d), table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("n_pieces > 1").select("item_kind", "item_id").distinct()


SQL_FOUND = """
WITH items AS (
  SELECT 'child' AS item_kind, child_id AS item_id, content AS t FROM child_chunks
  UNION ALL SELECT 'parent', parent_id, content FROM parent_chunks
  UNION ALL SELECT 'raw_text', doc_id || ':' || CAST(doc_version AS VARCHAR), raw_text FROM parsed_documents)
SELECT DISTINCT item_kind, item_id FROM items JOIN size_limits USING (item_kind) WHERE length(t) > max_chars
"""

QUERIES = {"p5_found": (p5_found, SQL_FOUND), "p5_pieces": (p5_pieces, None)}
