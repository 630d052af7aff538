"""Streaming forms of the telemetry and session operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder (or file) as a stream; TIMESTAMP_NTZ columns become TIMESTAMP, as watermarks need it.
    All files that are there make one batch: were they dealt out over several, the watermark of the first ones
    would drop what the others have from before, and the result would depend on the number of files."""
    reader = spark.readStream.schema(schema)
    rows = (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)
    ntz = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else rows


def event_windows(events: DataFrame, ts: str, kind: str, value: str, width: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Counts and sums of each kind in tumbling windows; events later than the watermark are dropped by Spark, which counts them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("started"), kind, "n", "total")


class Breaker(StatefulProcessor):
    """Circuit breaker of one agent: three failures in a row open it, after ``pause`` seconds it lets calls
    through on trial, two successes close it and a failure opens it again.  The state is three numbers, however many calls there are."""

    def __init__(self, failures: int = 3, pause: float = 30.0, successes: int = 2):
        self.failures, self.pause, self.successes = failures, pause, successes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "phase string, streak int, opened double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        phase, streak, opened = self.state.get() if self.state.exists() else ("closed", 0, 0.0)
        for pdf in rows:
            out = []
            for r in pdf.sort_values(["ts", "request_id"]).itertuples(index=False):
                phase, streak, opened, allowed = step(phase, streak, opened, r.ts, r.status != "error", self.failures, self.pause, self.successes)
                out.append((key[0], r.request_id, allowed, phase))
            yield pd.DataFrame(out, columns=["who", "request_id", "allowed", "phase"])
        self.state.update((phase, streak, opened))

    def close(self) -> None:
        pass


def step(phase: str, streak: int, opened: float, now: float, good: bool, failures: int, pause: float, successes: int) -> tuple[str, int, float, bool]:
    """One call: the new phase, the streak that counts in it, when it was opened, and whether the call was let through."""
    if phase == "open":
        if now - opened < pause:
            return phase, streak, opened, False
        phase, streak = "trial", 0
    if phase == "closed":
        streak = 0 if good else streak + 1
        return ("open", 0, now, True) if streak >= failures else (phase, streak, opened, True)
    if not good:
        return "open", 0, now, True
    streak += 1
    return ("closed", 0, opened, True) if streak >= successes else (phase, streak, opened, True)


def breaker(calls: DataFrame, key: str = "who") -> DataFrame:
    """who, request_id, allowed, phase for a stream of calls (request_id, ts, status)."""
    return calls.groupBy(key).transformWithStateInPandas(Breaker(), "who string, request_id long, allowed boolean, phase string", "Append", "None")


def run_once(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, then stop; what was written is not written again after a restart."""
    out.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
