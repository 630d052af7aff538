"""Queries of problem 2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronry.operators.references import Reference, orphan_counts, orphans
from heronry.tables import table


def _refs(spark: SparkSession, d: str) -> list[Reference]:
    parents = table(spark, d, "parent_chunks")
    return [
        Reference("child_chunks", table(spark, d, "child_chunks"), "child_id", "parent_id", "parent_chunks", parents, "parent_id"),
        Reference("parent_chunks", parents, "parent_id", "doc_id", "parsed_documents", table(spark, d, "parsed_documents"), "doc_id"),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans(_refs(spark, d), table(spark, d, "deletions"))
    return found.select("table_name", "row_id", "reason").distinct()


def p2_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(orphans(_refs(spark, d), table(spark, d, "deletions")))


def _ts(c: str) -> str:
    return (
        f"CAST(CASE WHEN regexp_matches(trim({c}), '[Zz]$|[+-][0-9]{{2}}:?[0-9]{{2}}$') AND regexp_matches(trim({c}), '[0-9]{{2}}:[0-9]{{2}}') "
        f"THEN trim({c}) ELSE trim({c}) || '+00' END AS TIMESTAMPTZ)"
    )


_KEY = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"

_ORPHANS = f"""
WITH del AS (
  SELECT lower(trim(target_table)) AS target, {_KEY.format(c="target_key")} AS key, max({_ts("deleted_at")}) AS last_deleted
  FROM deletions WHERE target_table IS NOT NULL GROUP BY 1, 2),
par AS (
  SELECT 'parent_chunks' AS target, {_KEY.format(c="parent_id")} AS key, {_ts("created_at")} AS created FROM parent_chunks
  UNION ALL
  SELECT 'parsed_documents', {_KEY.format(c="doc_id")}, {_ts("created_at")} FROM parsed_documents),
lft AS (
  SELECT p.target, p.key, count(*) AS n_left, min(p.created) AS first_left, max(CASE WHEN p.created IS NULL THEN 1 ELSE 0 END) AS unk
  FROM par p LEFT JOIN del d ON p.target = d.target AND p.key = d.key
  WHERE p.key IS NOT NULL AND (d.last_deleted IS NULL OR p.created IS NULL OR p.created > d.last_deleted) GROUP BY 1, 2),
ref AS (
  SELECT 'child_chunks' AS table_name, child_id AS row_id, 'parent_chunks' AS target, {_KEY.format(c="parent_id")} AS key, {_ts("created_at")} AS row_created FROM child_chunks
  UNION ALL
  SELECT 'parent_chunks', parent_id, 'parsed_documents', {_KEY.format(c="doc_id")}, {_ts("created_at")} FROM parent_chunks),
found AS (
  SELECT DISTINCT r.table_name, r.row_id, r.target, r.key, r.row_created,
    CASE WHEN l.key IS NOT NULL THEN 'late' WHEN d.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
  FROM ref r LEFT JOIN lft l ON r.target = l.target AND r.key = l.key LEFT JOIN del d ON r.target = d.target AND r.key = d.key
  WHERE r.key IS NOT NULL AND (l.key IS NULL OR (l.unk = 0 AND l.first_left > r.row_created)))
"""

SQL_FOUND = _ORPHANS + "SELECT DISTINCT table_name, row_id, reason FROM found"
SQL_PERIODS = _ORPHANS + (
    "SELECT table_name, coalesce(strftime(row_created AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period, reason, "
    "count(*) AS n_orphans, count(DISTINCT key) AS n_keys FROM found GROUP BY 1, 2, 3"
)

QUERIES = {
    "p2_found": (p2_found, SQL_FOUND),
    "p2_orphans_by_period": (p2_orphans_by_period, SQL_PERIODS),
}
