"""Queries of problem 1: percentiles of request durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.percentiles import ABSOLUTE_ERROR, PERCENTILES, agent_name, daily_values, endpoint_name, error_bound, multi_select
from heronry.tables import Staged, table

#: Ten binary digits: a daily result is off by at most 0.1 %.
DAILY_BITS = 10


def _values(spark: SparkSession, d: str, bits: int | None) -> DataFrame:
    return daily_values(
        table(spark, d, "requests"),
        {"endpoint": endpoint_name(F.col("endpoint")), "agent": agent_name(F.col("agent"))},
        F.col("duration_ms"),
        F.to_date(F.timestamp_seconds(F.floor("ts"))),
        ["request_id", "ts"],
        bits,
    )


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of all days per endpoint and per agent."""
    return multi_select(_values(spark, d, None)).select("dimension", "grp", "p", "n", "value")


def p1_daily_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same from daily results of bounded size, kept as a table and combined, with the bound on the error."""
    daily = Staged(_values(spark, d, DAILY_BITS), "daily").df
    return multi_select(daily).select("dimension", "grp", "p", "n", "value", F.lit(error_bound(DAILY_BITS)).alias("max_relative_error"), F.lit(ABSOLUTE_ERROR).alias("max_absolute_error"))


def p1_daily_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median and 99th percentile of each day, endpoint and agent: the day is part of the group."""
    daily = _values(spark, d, DAILY_BITS)
    keyed = daily.withColumn("grp", F.concat_ws("\t", F.coalesce(F.col("day").cast("string"), F.lit("unknown")), "grp"))
    return multi_select(keyed, (0.5, 0.99)).select(
        F.split("grp", "\t")[0].alias("day"), "dimension", F.split("grp", "\t")[1].alias("grp"), "p", "n", "value"
    )


def _sql(value: str, by_day: bool, ps: tuple[float, ...], extra: str = "") -> str:
    group = "day, dimension, grp" if by_day else "dimension, grp"
    return f"""
WITH once AS (
  SELECT DISTINCT request_id, ts, duration_ms AS v,
    coalesce(strftime(CAST(to_timestamp(floor(ts)) AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d'), 'unknown') AS day,
    coalesce(nullif(regexp_replace(regexp_replace(lower(trim(endpoint)), '(.)/+$', '\\1'), '/[0-9a-f]{{8,}}$', '/{{id}}'), ''), 'unknown') AS endpoint,
    coalesce(nullif(lower(trim(agent)), ''), 'unknown') AS agent
  FROM requests WHERE duration_ms > 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms)),
long AS (
  SELECT day, 'endpoint' AS dimension, endpoint AS grp, {value} AS value FROM once
  UNION ALL SELECT day, 'agent', agent, {value} FROM once),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY value) - 1 AS rk, count(*) OVER (PARTITION BY {group}) AS n FROM long),
ps AS (SELECT unnest([{", ".join(f"CAST({p} AS DOUBLE)" for p in ps)}]) AS p)
SELECT {group}, p, n, value{extra} FROM ranked, ps WHERE rk = least(CAST(floor(n * p) AS BIGINT), n - 1)
"""


_MICRO = "CAST(round(v * 1000) AS BIGINT)"
_SHIFT = f"greatest(0, length(bin({_MICRO})) - {DAILY_BITS})"
_CUT = f"((({_MICRO} >> {_SHIFT}) << {_SHIFT}) + CASE WHEN {_SHIFT} > 0 THEN CAST(1 AS BIGINT) << ({_SHIFT} - 1) ELSE 0 END) / 1000.0"

QUERIES = {
    "p1_percentiles": (p1_percentiles, _sql("v", False, PERCENTILES)),
    "p1_daily_combined": (p1_daily_combined, _sql(_CUT, False, PERCENTILES, f", CAST({error_bound(DAILY_BITS)!r} AS DOUBLE) AS max_relative_error, CAST({ABSOLUTE_ERROR!r} AS DOUBLE) AS max_absolute_error")),
    "p1_daily_medians": (p1_daily_medians, _sql(_CUT, True, (0.5, 0.99))),
}
