"""Queries of the telemetry operators over the request records."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import telemetry as tm
from heronry.tables import table

_R = "r AS (SELECT DISTINCT *, coalesce(nullif(trim(agent), ''), nullif(trim(endpoint), ''), 'unknown') AS who, CASE WHEN duration_ms > 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms) THEN duration_ms END AS ms FROM requests)"


def _rows(spark, d, *columns):
    return tm.records(table(spark, d, "requests"), *columns)


def q_metrics_snapshot(spark, d):
    return tm.snapshot(_rows(spark, d, "ts", "session_id", "duration_ms", "status", "tokens"))


def q_ring_snapshot(spark, d):
    return tm.snapshot(tm.last(_rows(spark, d, "ts", "session_id", "duration_ms", "status", "tokens")))


def _snapshot_sql(src: str) -> str:
    return f"""WITH {_R}, s AS ({src}), m AS (SELECT max(ts) AS t FROM s), x AS (SELECT s.*, t - ts <= 60.0 AS recent FROM s, m)
SELECT count(*) AS total_requests, count(DISTINCT nullif(session_id, '')) AS active_sessions,
 CASE WHEN count(*) FILTER (recent) >= 2 THEN round(count(*) FILTER (recent) / greatest(max(ts) FILTER (recent) - min(ts) FILTER (recent), 0.001), 2) ELSE 0.0 END AS qps,
 coalesce(round(avg(ms) FILTER (recent), 1), 0.0) AS avg_latency_ms, round(avg(CASE WHEN status = 'error' THEN 1.0 WHEN status IS NOT NULL THEN 0.0 END), 4) AS error_rate, coalesce(sum(tokens), 0) AS total_tokens FROM x"""


def q_tokens_by_agent(spark, d):
    return tm.tokens_by(_rows(spark, d, "who", "tokens"))


def q_tokens_by_minute(spark, d):
    return tm.tokens_by_minute(_rows(spark, d, "ts", "tokens"))


_PS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def q_latency_distribution(spark, d):
    return tm.at_rank(_rows(spark, d, "status", "duration_ms"), ["status"], tm.measured(), _PS)


def q_agent_performance(spark, d):
    """Every agent that was seen, with the latency of the last hour; an agent without records in it has zeros."""
    rows = _rows(spark, d, "who", "ts", "duration_ms")
    newest = rows.agg(F.max("ts").alias("m")).scalar()
    hour = tm.at_rank(rows.where(F.col("ts") >= newest - 3600), ["who"], tm.measured(), {"p50": 0.5, "p99": 0.99})
    return rows.select("who").distinct().join(hour, "who", "full_outer").fillna(0).select("who", "n", "avg", "p50", "p99", "most")


def _rank_sql(src: str, by: str, ps: dict) -> str:
    cols = ", ".join(f"min(CASE WHEN upto > floor(whole * {p}) THEN ms END) AS {k}" for k, p in ps.items())
    return f"""c AS (SELECT {by}, ms, count(*) AS k FROM {src} WHERE ms IS NOT NULL GROUP BY 1, 2),
u AS (SELECT *, sum(k) OVER (PARTITION BY {by} ORDER BY ms) AS upto, sum(k) OVER (PARTITION BY {by}) AS whole FROM c),
g AS (SELECT {by}, CAST(sum(k) AS BIGINT) AS n, round(sum(ms * k) / sum(k), 1) AS avg, min(ms) AS least, max(ms) AS most, {cols} FROM u GROUP BY 1)"""


def q_quality_proxy(spark, d):
    return tm.quality(_rows(spark, d, "status", "duration_ms"))


def q_slow_top10(spark, d):
    return tm.slowest(_rows(spark, d, "endpoint", "duration_ms", "status"))


def q_log_levels(spark, d):
    rows = _rows(spark, d, "ts", "status", "duration_ms").withColumn("level", tm.log_level())
    return rows.groupBy("level", F.to_date(F.timestamp_seconds(F.floor("ts"))).cast("string").alias("day")).agg(F.count("*").alias("n"))


def q_sessions(spark, d):
    return tm.sessions(_rows(spark, d, "session_id", "ts", "tokens", "duration_ms", "status"))


def q_activity_windows(spark, d):
    return tm.activity_windows(_rows(spark, d, "session_id", "ts"))


def q_late_arrivals(spark, d):
    """Records by days between the event and its arrival."""
    rows = _rows(spark, d, "ts", "ingested_at").where("ts is not null and ingested_at is not null")
    days = F.floor((F.unix_micros("ingested_at") / 1e6 - F.col("ts")) / 86400).cast("int")
    return rows.groupBy(days.alias("days_late")).agg(F.count("*").alias("n"))


QUERIES = {
    "q_metrics_snapshot": (q_metrics_snapshot, _snapshot_sql("SELECT * FROM r")),
    "q_ring_snapshot": (q_ring_snapshot, _snapshot_sql("SELECT * FROM r WHERE ts IS NOT NULL ORDER BY ts DESC, request_id DESC LIMIT 1000")),
    "q_tokens_by_agent": (
        q_tokens_by_agent,
        f"WITH {_R}, g AS (SELECT who, coalesce(sum(tokens), 0) AS t, count(*) AS n FROM r GROUP BY 1) SELECT who, t AS tokens, n AS requests, round(t / n, 0) AS avg_tokens, CASE WHEN sum(t) OVER () > 0 THEN round(t * 100.0 / sum(t) OVER (), 1) ELSE 0.0 END AS pct FROM g",
    ),
    "q_tokens_by_minute": (
        q_tokens_by_minute,
        f"WITH {_R} SELECT strftime(to_timestamp(floor(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute, coalesce(sum(tokens), 0) AS tokens, count(*) AS requests FROM r WHERE ts IS NOT NULL GROUP BY 1",
    ),
    "q_latency_distribution": (q_latency_distribution, f"WITH {_R}, {_rank_sql('r', 'status', _PS)} SELECT * FROM g"),
    "q_agent_performance": (
        q_agent_performance,
        f"WITH {_R}, h AS (SELECT * FROM r WHERE ts >= (SELECT max(ts) FROM r) - 3600), {_rank_sql('h', 'who', {'p50': 0.5, 'p99': 0.99})} SELECT coalesce(a.who, g.who) AS who, coalesce(n, 0) AS n, coalesce(avg, 0) AS avg, coalesce(p50, 0) AS p50, coalesce(p99, 0) AS p99, coalesce(most, 0) AS most FROM (SELECT DISTINCT who FROM r) a FULL JOIN g ON a.who = g.who",
    ),
    "q_quality_proxy": (
        q_quality_proxy,
        f"WITH {_R}, o AS (SELECT count(*) AS n, avg(CASE WHEN status = 'success' THEN 1.0 WHEN status IS NOT NULL THEN 0.0 END) AS rc, avg(CASE WHEN duration_ms < 3000 AND NOT isnan(duration_ms) THEN 1.0 ELSE 0.0 END) AS pr, coalesce(avg(ms), 0.0) AS l FROM r) SELECT n, round(rc, 4) AS recall, round(pr, 4) AS precision, round(CASE WHEN rc + pr > 0 THEN 2 * rc * pr / (rc + pr) ELSE 0.0 END, 4) AS f1, round(least(1.0, greatest(0.0, rc * greatest(0.0, 1 - l / 10000))), 4) AS score FROM o",
    ),
    "q_slow_top10": (q_slow_top10, f"WITH {_R} SELECT request_id, endpoint, duration_ms, status FROM r WHERE ms > 1000 ORDER BY duration_ms DESC, request_id LIMIT 10"),
    "q_log_levels": (
        q_log_levels,
        f"WITH {_R} SELECT CASE WHEN status = 'error' THEN 'ERROR' WHEN ms > 5000 THEN 'WARNING' ELSE 'INFO' END AS level, strftime(to_timestamp(floor(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM r GROUP BY 1, 2",
    ),
    "q_sessions": (
        q_sessions,
        f"WITH {_R}, g AS (SELECT session_id, count(*) AS requests, coalesce(sum(tokens), 0) AS tokens, round(avg(ms), 1) AS avg_latency_ms, max(ts) AS last_ts, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS errors FROM r WHERE session_id <> '' GROUP BY 1), i AS (SELECT g.*, CAST(floor((SELECT max(ts) FROM r) - last_ts) AS BIGINT) AS idle_s FROM g) SELECT *, CASE WHEN idle_s < 60 THEN idle_s || 's' WHEN idle_s < 3600 THEN (idle_s // 60) || 'min' ELSE (idle_s // 3600) || 'h' END AS idle, idle_s > 300 AS dead FROM i",
    ),
    "q_activity_windows": (
        q_activity_windows,
        f"WITH {_R}, t AS (SELECT session_id, make_timestamptz(CAST(floor(ts * 1000000) AS BIGINT)) AS t0 FROM r WHERE session_id <> '' AND ts IS NOT NULL), l AS (SELECT *, lag(t0) OVER (PARTITION BY session_id ORDER BY t0) AS prev FROM t), b AS (SELECT *, sum(CASE WHEN prev IS NULL OR t0 >= prev + INTERVAL 300 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t0) AS g FROM l) SELECT session_id, min(t0) AS started, max(t0) + INTERVAL 300 SECOND AS ended, count(*) AS requests FROM b GROUP BY session_id, g",
    ),
    "q_late_arrivals": (q_late_arrivals, f"WITH {_R} SELECT CAST(floor((epoch_us(ingested_at) / 1e6 - ts) / 86400) AS INTEGER) AS days_late, count(*) AS n FROM r WHERE ts IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1"),
}
