import math
import random

from pyspark.sql import functions as F

from heronry.llm.percentiles import ABSOLUTE_ERROR, combine, cut, daily_values, error_bound, multi_select

SCHEMA = "request_id long, day string, endpoint string, duration double, dimension string, value string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def daily(df, bits=None):
    return daily_values(df, {"endpoint": F.col("endpoint")}, F.col("duration"), F.col("day"), ["request_id"], bits)


def brute(rows, p):
    groups = {}
    for _, _, g, v in set(rows):
        if v is not None and 0 < v < math.inf:
            groups.setdefault(g, []).append(v)
    return {g: sorted(v)[min(int(len(v) * p), len(v) - 1)] for g, v in groups.items()}


def data(n=3000):
    rnd = random.Random(2)
    rows = [(i, f"d{i % 4}", "hot" if i % 3 == 0 else f"e{rnd.randrange(5)}", rnd.choice([round(math.exp(rnd.gauss(5, 2)), 3), 100.0, 7.5])) for i in range(n)]
    rows += [(n, None, "hot", None), (n + 1, "d1", "hot", math.nan), (n + 2, "d1", "e1", -3.0), (n + 3, "d1", "e1", 0.0), (n + 4, "d1", "only", math.inf), (n + 5, None, "single", 4.0)]
    return rows + rows[:50]


def test_exact_with_ties_nulls_and_copies(spark):
    rows = data()
    for finish in (1, 16, 100_000):
        got = {(r.grp, r.p): r.value for r in multi_select(daily(table(spark, rows)), (0.0, 0.5, 0.99, 1.0), finish).collect()}
        want = {(g, p): v for p in (0.0, 0.5, 0.99, 1.0) for g, v in brute(rows, p).items()}
        assert got == want


def test_days_combine_within_the_bound(spark):
    rows = data(1500)
    df = table(spark, rows)
    parts = [daily(df.where(F.coalesce("day", F.lit("d0")) == f"d{k}"), 8) for k in range(4)]
    got = {r.grp: r.value for r in multi_select(combine(*parts), (0.5,)).collect()}
    for g, v in brute(rows, 0.5).items():
        assert abs(got[g] - v) <= error_bound(8) * v + 0.001


def test_cells_hold_their_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (0.001, 1, 999, 12345.678, 1e8)], "v double")
    for r in df.select("v", cut(F.col("v"), 6).alias("c")).collect():
        assert abs(r.c - r.v) <= error_bound(6) * r.v + 1e-3


def test_empty(spark):
    assert multi_select(daily(table(spark, []))).count() == 0
    assert multi_select(daily(table(spark, [(1, "d", "e", None)]))).count() == 0


def test_cut_values_keep_the_stated_bound(spark):
    values = [10**k * m for k in range(-4, 7) for m in (1.0, 1.4, 1.49, 2.7, 9.99)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", cut(F.col("v"), 10).alias("c")).collect():
        assert abs(r.c - r.v) <= error_bound(10) * r.v + ABSOLUTE_ERROR + 1e-12
