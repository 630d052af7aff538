import random

from heronry.llm.mixing import UNIT, count_tokens, mix, plan, shares
from heronry.llm.mixing_queries import TOKENIZER

TARGETS = "mix_id string, source string, target_share double, max_repeats int, tokens int"


def docs(spark):
    rnd = random.Random(4)
    rows = [(i, ["a", " A ", "b", "c-x", "c_x"][i % 5] if i % 7 else "a", rnd.randrange(1, 300)) for i in range(900)]
    rows += [(900, None, 50), (901, "a", 0), (902, "a", None), (903, "big", 100_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, tokens long, copies int"), rows


def test_shares_and_caps(spark):
    df, rows = docs(spark)
    targets = spark.createDataFrame([("m", "a", 0.5, 2, 1), ("m", "b", 0.3, 3, 1), ("m", "C_X", 0.2, 1, 1), ("n", "b", 0.6, 2, 1), ("n", "gone", 0.4, 9, 1), ("z", "gone", 1.0, 1, 1), ("m", None, 0.2, 1, 1), ("m", "big", 0.0, 1, 1)], TARGETS)
    out = mix(df, targets).collect()
    size = {r[0]: r[2] for r in rows}
    cap = {("m", "a"): 2, ("m", "b"): 3, ("m", "c_x"): 1, ("n", "b"): 2}
    assert {(r.mix_id, r.source) for r in out} == set(cap) and all(1 <= r.copies <= cap[r.mix_id, r.source] for r in out)
    assert len({(r.mix_id, r.doc_id) for r in out}) == len(out)
    used = {k: sum(r.copies * size[r.doc_id] for r in out if (r.mix_id, r.source) == k) for k in cap}
    whole = sum(v for k, v in used.items() if k[0] == "m")
    for s, want in (("a", 0.5), ("b", 0.3), ("c_x", 0.2)):
        assert abs(used["m", s] / whole - want) < 0.02
    report = {(r.mix_id, r.source): r for r in shares(mix(df, targets), df, targets).collect()}
    assert report["n", "gone"].actual_share == 0 and report["z", "gone"].tokens_used == 0 and abs(report["m", "a"].actual_share - used["m", "a"] / whole) < 1e-5


def test_every_copy_is_the_crossing_of_a_whole_number(spark):
    """Against a plain prefix sum: the copies of a source sum to the whole numbers that its sum crosses."""
    df, rows = docs(spark)
    targets = spark.createDataFrame([("m", "a", 0.7, 2, 1), ("m", "b", 0.3, 2, 1)], TARGETS)
    from pyspark.sql import functions as F

    from heronry.llm.mixing import source_name

    known = df.withColumn("source", source_name(F.col("source"))).where("source is not null and tokens > 0")
    sizes = known.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    for r in plan(sizes, targets).collect():
        got = mix(df, targets).where(F.col("source") == r.source).agg(F.sum("copies")).first()[0]
        assert abs(got - r.docs * r.copies / UNIT) <= 1


def test_total_and_empty(spark):
    df, _ = docs(spark)
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 1), ("m", "b", 0.5, 1, 1)], TARGETS)
    assert mix(df, targets, total=1e9).groupBy("source").max("copies").collect()[0][1] == 1
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "退货" * 3000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in count_tokens(df, TOKENIZER).collect()}
    assert got[1] in (2, 3) and got[2] == got[3] == 0 and got[4] > 1000
