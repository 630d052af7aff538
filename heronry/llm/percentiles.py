"""Percentiles of very large numeric columns (problem 1): distributed multi-select.

1. ``daily_values`` turns the rows into partial results that can be kept and combined later: one row
   per day, group and value with its count.  With ``bits`` the values are cut to that many significant
   binary digits first, so that a day's result is small and every later answer is off by at most
   2**-bits of itself and half of a thousandth; without it the results are exact.  Results of separate days or partitions are
   combined by a plain union.
2. ``multi_select`` answers all percentiles of all groups at once.  In each round every partition
   proposes the median of its candidates of each open range (a bounded sketch: any candidate is a
   valid pivot), the median of the proposals weighted by their counts becomes the pivot, the candidates
   are counted three ways (below, equal, above), and the ranges that cannot hold a wanted rank are
   discarded.  A range with few distinct values left is finished by its running count.

The rank of percentile p among n values is floor(n * p), counted from 0, at most n - 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heronry.tables import Staged

PERCENTILES = (0.25, 0.5, 0.9, 0.95, 0.99)
#: A range with at most this many distinct values is finished directly.
FINISH = 1024
#: Values are kept in whole thousandths before digits are cut: the largest absolute error beside the relative one.
ABSOLUTE_ERROR = 0.0005
#: The candidates are written anew when at most this share of them is still open.
REWRITE = 0.34


def endpoint_name(c: Column) -> Column:
    """Spellings of one endpoint fall together: case, white space, a slash at the end, ids in the path."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"(.)/+$", "$1")
    name = F.regexp_replace(name, r"/[0-9a-f]{8,}$", "/{id}")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)


def agent_name(c: Column) -> Column:
    name = F.lower(F.trim(c))
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)


def cut(value: Column, bits: int | None) -> Column:
    """The value as whole microunits with ``bits`` significant binary digits, in the middle of its cell."""
    if not bits:
        return value
    micro = F.round(value * 1000).cast("long")
    shift = F.greatest(F.lit(0), F.length(F.bin(micro)) - bits)
    cell = F.call_function("shiftleft", F.call_function("shiftright", micro, shift), shift)
    half = F.when(shift > 0, F.call_function("shiftleft", F.lit(1).cast("long"), shift - 1)).otherwise(F.lit(0).cast("long"))
    return (cell + half) / 1000.0


def daily_values(
    rows: DataFrame,
    groups: dict[str, Column],
    value: Column,
    day: Column,
    key: list[str],
    bits: int | None = None,
) -> DataFrame:
    """Partial results: day, dimension, grp, value, n.

    ``key`` names the columns that identify a record; repeated records count once.  Values that are
    null, NaN, infinite, zero or negative are no measurements and are left out.  Rows without a day
    are in the day null.  An empty table gives an empty result.
    """
    named = {f"__g{i}": c for i, c in enumerate(groups.values())}
    once = (
        rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], day.alias("day"), value.cast("double").alias("value"), *[c.alias(n) for n, c in named.items()])
        .where("value > 0 and value < double('infinity')")
        .distinct()
    )  # NaN sorts above infinity
    cells = once.select(
        "day",
        cut(F.col("value"), bits).alias("value"),
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(n).alias("grp")) for d, n in zip(groups, named)])).alias("g"),
    )
    return cells.groupBy("day", "g.dimension", "g.grp", "value").agg(F.count("*").alias("n"))


def combine(*parts: DataFrame) -> DataFrame:
    """Results of separate days or partitions as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranges(open_: DataFrame) -> DataFrame:
    return open_.select("dimension", "grp", "lo", "hi").distinct()


def _within(candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    """Candidates with the one open range that they lie in: open ranges of a group never overlap."""
    return candidates.join(ranges, ["dimension", "grp"]).where("value > lo and value < hi")


def multi_select(values: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, finish: int = FINISH) -> DataFrame:
    """dimension, grp, p, n, rank, value: the exact value of each wanted rank in ``values``
    (dimension, grp, value, n; other columns are ignored).

    Each round halves the open ranges, about; a round costs two passes over the candidates that are
    still open, and ties are found by the equal count.  The ranges are one row per group and
    percentile and are joined by the size that Spark measures for them.
    """
    candidates = Staged(values.select("dimension", "grp", "value", "n"), "candidates")
    inf = float("inf")
    wanted = F.explode(F.array(*[F.lit(p) for p in percentiles]))
    start = (
        candidates.df.groupBy("dimension", "grp")
        .agg(F.sum("n").alias("total"), F.count("*").alias("open_rows"))
        .withColumn("p", wanted)
        .withColumn("rank", F.least(F.floor(F.col("total") * F.col("p")), F.col("total") - 1))
        .select(
            "dimension", "grp", "p", "total", "rank", F.col("rank").alias("left"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"),
            "open_rows", F.lit(None).cast(T.DoubleType()).alias("found"),
        )
    )
    state = Staged(start, "ranks")
    kept = _measure(state.df, finish)["all_rows"]
    while True:
        now = _measure(state.df, finish)
        if not now["n_open"]:
            break
        if now["all_rows"] <= REWRITE * kept:
            smaller = Staged(_within(candidates.df, _ranges(state.df.where("found is null"))).select("dimension", "grp", "value", "n"), "candidates")
            candidates.drop()
            candidates, kept = smaller, now["all_rows"]
        after = Staged(_round(candidates.df, state.df, finish), "ranks")
        state.drop()
        state = after
    return _finish(candidates.df, state.df)


def _measure(state: DataFrame, finish: int) -> dict:
    """How many ranks are open beyond ``finish`` values, and how many candidates the open ranges hold."""
    ranges = state.where("found is null").groupBy("dimension", "grp", "lo", "hi").agg(F.max("open_rows").alias("rows"))
    got = ranges.agg(F.sum(F.when(F.col("rows") > finish, 1)).alias("n_open"), F.sum("rows").alias("all_rows")).first()
    return {"n_open": got.n_open or 0, "all_rows": got.all_rows or 0}


def _round(candidates: DataFrame, state: DataFrame, finish: int) -> DataFrame:
    by = ["dimension", "grp", "lo", "hi"]
    ranges = _ranges(state.where(f"found is null and open_rows > {finish}"))
    local = (
        _within(candidates, ranges)
        .withColumn("part", F.spark_partition_id())
        .groupBy(*by, "part")
        .agg(F.percentile_approx("value", 0.5, 200).alias("median"), F.sum("n").alias("weight"))
    )
    run = Window.partitionBy(*by).orderBy("median", "part")
    pivots = (
        local.withColumn("upto", F.sum("weight").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all", F.sum("weight").over(Window.partitionBy(*by)))
        .where("2 * upto >= all")
        .groupBy(*by)
        .agg(F.min("median").alias("pivot"))
    )
    counts = (
        _within(candidates, pivots)
        .groupBy(*by, "pivot")
        .agg(
            F.sum(F.when(F.col("value") < F.col("pivot"), F.col("n")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("value") == F.col("pivot"), F.col("n")).otherwise(0)).alias("equal"),
            F.sum(F.when(F.col("value") < F.col("pivot"), 1).otherwise(0)).alias("below_rows"),
            F.sum(F.when(F.col("value") > F.col("pivot"), 1).otherwise(0)).alias("above_rows"),
        )
    )
    low, high = F.col("left") < F.col("below"), F.col("left") >= F.col("below") + F.col("equal")
    none = F.col("pivot").isNull()
    return state.join(counts, by, "left").select(
        "dimension", "grp", "p", "total", "rank",
        F.when(none | ~high, F.col("left")).otherwise(F.col("left") - F.col("below") - F.col("equal")).alias("left"),
        F.when(none | ~high, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
        F.when(none | ~low, F.col("hi")).otherwise(F.col("pivot")).alias("hi"),
        F.when(none, F.col("open_rows")).when(low, F.col("below_rows")).when(high, F.col("above_rows")).otherwise(F.lit(0)).cast("long").alias("open_rows"),
        F.when(~none & ~low & ~high, F.col("pivot")).otherwise(F.col("found")).alias("found"),
    )


def _finish(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Ranges of at most ``finish`` distinct values: the value whose running count passes the rank."""
    by = ["dimension", "grp", "lo", "hi"]
    open_ = state.where("found is null")
    merged = _within(candidates, _ranges(open_)).groupBy(*by, "value").agg(F.sum("n").alias("n"))
    upto = merged.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("value")))
    last = open_.join(upto, by).where("left < upto").groupBy("dimension", "grp", "p", "total", "rank").agg(F.min("value").alias("value"))
    done = state.where("found is not null").select("dimension", "grp", "p", "total", "rank", F.col("found").alias("value"))
    return done.unionByName(last).select("dimension", "grp", "p", F.col("total").alias("n"), "rank", "value")


def error_bound(bits: int | None) -> float:
    """Largest relative error of a value: half a cell of its last kept digit.  Half a thousandth comes on top (ABSOLUTE_ERROR)."""
    return 0.0 if not bits else math.ldexp(1.0, -bits)
