"""Aggregates over request records: throughput, latency, tokens, sessions.

``as_of`` is the moment of the report; without it, the newest record's time.  Nothing depends on the
clock, so a report can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of the sliding window, and records of the ring that the reports look back on.
WINDOW_S, RING = 60.0, 1000
#: Ranges of values to a doubling, in the search for ranks.
STEPS = 32
SLOW_MS, WARN_MS, FAST_MS, IDLE_S = 1000.0, 5000.0, 3000.0, 300.0


def records(requests: DataFrame, *columns: str) -> DataFrame:
    """Each record once, its id and the named columns (all without any); ``who`` is the agent, or the endpoint without one.

    Repeated rows are complete copies, so the id and what a report reads tell them: nothing else is shuffled."""
    agent = F.coalesce(F.when(F.trim("agent") != "", F.trim("agent")), F.when(F.trim("endpoint") != "", F.trim("endpoint")), F.lit("unknown"))
    rows = requests.withColumn("who", agent)
    return (rows.select("request_id", *columns) if columns else rows).distinct()


def last(rows: DataFrame, n: int = RING) -> DataFrame:
    """The newest ``n`` records: per-partition heaps, no global sort."""
    return rows.where("ts is not null").orderBy(F.desc("ts"), F.desc("request_id")).limit(n)


def measured(c: str = "duration_ms") -> Column:
    """The duration where it is a number above zero, else null."""
    return F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))


def snapshot(rows: DataFrame, as_of: float | None = None) -> DataFrame:
    """One row: total, active sessions, requests per second and mean latency of the window, error rate."""
    newest = F.lit(as_of) if as_of is not None else rows.agg(F.max("ts").alias("m")).scalar()
    rows = rows.withColumn("recent", (newest - F.col("ts")) <= WINDOW_S)
    t, n = F.when(F.col("recent"), F.col("ts")), F.count(F.when(F.col("recent"), 1))
    qps = F.when(n >= 2, F.round(n / F.greatest(F.max(t) - F.min(t), F.lit(0.001)), 2)).otherwise(0.0)
    return rows.agg(
        F.count("*").alias("total_requests"),
        F.countDistinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("active_sessions"),
        qps.alias("qps"),
        F.coalesce(F.round(F.avg(F.when(F.col("recent"), measured())), 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.round(F.avg((F.col("status") == "error").cast("double")), 4).alias("error_rate"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    )


def tokens_by(rows: DataFrame, key: str = "who") -> DataFrame:
    """Tokens, requests, mean and share of each key; shares add up over the grouped rows only."""
    per = rows.groupBy(key).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("requests"))
    whole = per.agg(F.sum("tokens").alias("t")).scalar()
    return per.select(key, "tokens", "requests", F.round(F.col("tokens") / F.col("requests"), 0).alias("avg_tokens"), F.when(whole > 0, F.round(F.col("tokens") * 100.0 / whole, 1)).otherwise(0.0).alias("pct"))


def tokens_by_minute(rows: DataFrame) -> DataFrame:
    return rows.where("ts is not null").groupBy(F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd HH:mm").alias("minute")).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("requests"))


def at_rank(rows: DataFrame, by: list[str], value: Column, ps: dict[str, float]) -> DataFrame:
    """Of each group the value at place floor(n * p) of the ascending order, from 0, and count, mean, least and most.

    Two levels: counts per range of values (STEPS of them to a doubling, so a group has a bounded number) tell which
    range holds a rank; only the values of those ranges are put in order, each range by itself.  A null key is a group
    of its own; null values do not count; a group without values has no row."""
    cells = rows.select(*by, value.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    cells = cells.withColumn("range", (F.signum("v") * F.floor(F.log2(1 + F.abs("v")) * STEPS)).cast("long"))
    ranges = cells.groupBy(*by, "range").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    group = Window.partitionBy(*by)
    placed = ranges.withColumns({"below": F.sum("n").over(group.orderBy("range")) - F.col("n"), "whole": F.sum("n").over(group)})
    asked = placed.select(*by, "range", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.floor(F.col("whole") * p) - F.col("below")).cast("long").alias("at")) for k, p in ps.items()])).alias("p"), "n")
    asked = asked.where("p.at >= 0 and p.at < n").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("range").alias("_range"), "p.name", "p.at")
    same = F.col("range") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    near = cells.join(asked, same).withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "range", "name").orderBy("v")))
    hits = near.where(F.col("upto") > F.col("at")).groupBy(*by).agg(*[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ps])
    whole = ranges.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 1).alias("avg"), F.min("least").alias("least"), F.max("most").alias("most"))
    keys = F.lit(True)
    for c in by:
        keys = keys & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return whole.join(hits, keys).select(*by, "n", "avg", "least", "most", *ps)


def quality(rows: DataFrame) -> DataFrame:
    """Proxies of answer quality from success and speed."""
    n, good = F.count("*"), F.avg((F.col("status") == "success").cast("double"))
    fast = F.avg((F.coalesce(F.when(F.isnan("duration_ms"), None).otherwise(F.col("duration_ms")), F.lit(1e18)) < FAST_MS).cast("double"))
    latency = F.coalesce(F.avg(measured()), F.lit(0.0))
    one = rows.agg(n.alias("n"), good.alias("recall"), fast.alias("precision"), latency.alias("latency"))
    f1 = F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("recall") * F.greatest(F.lit(0.0), 1 - F.col("latency") / 10000)))
    return one.select("n", F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"), F.round(f1, 4).alias("f1"), F.round(score, 4).alias("score"))


def slowest(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.where(measured() > SLOW_MS).orderBy(F.desc("duration_ms"), "request_id").limit(n).select("request_id", "endpoint", "duration_ms", "status")


def log_level() -> Column:
    return F.when(F.col("status") == "error", "ERROR").when(measured() > WARN_MS, "WARNING").otherwise("INFO")


def sessions(rows: DataFrame, as_of: float | None = None) -> DataFrame:
    """Per session: requests, tokens, mean latency, last activity, and whether it is dead; the hot session is pre-aggregated map-side."""
    newest = F.lit(as_of) if as_of is not None else rows.agg(F.max("ts").alias("m")).scalar()
    per = rows.where("session_id is not null and session_id <> ''").groupBy("session_id").agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.avg(measured()), 1).alias("avg_latency_ms"), F.max("ts").alias("last_ts"), F.sum((F.col("status") == "error").cast("long")).alias("errors")
    )
    idle = F.floor(newest - F.col("last_ts"))
    text = F.when(idle < 60, F.concat(idle.cast("string"), F.lit("s"))).when(idle < 3600, F.concat(F.floor(idle / 60).cast("string"), F.lit("min"))).otherwise(F.concat(F.floor(idle / 3600).cast("string"), F.lit("h")))
    return per.withColumns({"idle_s": idle, "idle": text, "dead": idle > IDLE_S})


def activity_windows(rows: DataFrame, gap_s: float = 300.0, slot_s: float = 3600.0) -> DataFrame:
    """session_id, started, ended, requests: stretches of activity; a pause of ``gap_s`` seconds ends one, and its end is that
    much after its last record.

    A session is cut into slots of time, so that a hot one is many groups; the slots then tell each other their last record
    and how many stretches they begin, one row a slot."""
    rows = rows.where("session_id is not null and session_id <> '' and ts is not null").withColumn("at", F.floor(F.col("ts") * 1e6).cast("long"))
    rows = rows.withColumn("slot", F.floor(F.col("at") / (slot_s * 1e6)).cast("long"))
    gap = int(gap_s * 1e6)
    inner = Window.partitionBy("session_id", "slot").orderBy("at")
    rows = rows.withColumn("breaks", (F.col("at") - F.lag("at").over(inner) >= gap).cast("int")).withColumn("k", F.coalesce(F.sum("breaks").over(inner.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    parts = rows.groupBy("session_id", "slot", "k").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    # one row for each stretch of a slot; the first of a slot can go on with the last of the slot before
    outer = Window.partitionBy("session_id").orderBy("slot", "k")
    parts = parts.withColumn("opens", F.coalesce((F.col("a") - F.lag("b").over(outer) >= gap).cast("int"), F.lit(1))).withColumn("w", F.sum("opens").over(outer))
    out = parts.groupBy("session_id", "w").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("requests"))
    return out.select("session_id", F.timestamp_micros("a").alias("started"), F.timestamp_micros(F.col("b") + gap).alias("ended"), "requests")
