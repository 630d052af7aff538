"""Structured Streaming jobs over the given tables; each runs over all that is there and gives its sink as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heronry.streaming import windows as sw
from heronry.tables import shared_dir, table


def _run(spark, out):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sw.run_once(out, f"{base}/out", f"{base}/state")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def q_stream_windows(spark, d):
    """Closed hourly windows of the events per type; the window that is still open is not given.
    The path is a pattern, as a stream takes a folder or a pattern but no single file."""
    path = f"{d}/events.parquet"
    events = sw.source(spark, path[:-1] + "[t]", spark.read.parquet(path).schema)
    return _run(spark, sw.event_windows(events, "ts", "event_type", "value", "1 hour", "1 hour")).select("started", "event_type", "n", F.round("total", 4).alias("total"))


def q_event_windows(spark, d):
    """The same as a batch, all windows."""
    rows = table(spark, d, "events")
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


QUERIES = {
    "q_event_windows": (q_event_windows, "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "q_stream_windows": (
        q_stream_windows,
        "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    ),
}
