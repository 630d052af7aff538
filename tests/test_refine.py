from pyspark.sql import functions as F

from heronry.operators import refine as rf


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_rule_clean(spark):
    assert one(spark, " a  b \n\n\n12\n第 3 页\n\nc\n- 4 -", rf.rule_clean) == "a b\n\n\nc"
    assert one(spark, "", rf.rule_clean) == "" and one(spark, None, rf.rule_clean) is None


def test_summary(spark):
    assert one(spark, "一。二。三", rf.summary) == "一。二。三"
    assert one(spark, f"头。{'长' * 150}。中\n尾。", rf.summary) == f"头。{'长' * 100}。尾。"
    assert one(spark, "a。b。c。d", rf.summary) == "a。d。"


def test_answering(spark):
    df = spark.createDataFrame([("退货 多久", "先看这里。退货要三天。完。"), ("没有", "一。二。三。四。"), (None, None)], "q string, t string")
    assert [(r.refined, r.n_hits) for r in rf.answering(df, "q", "t").collect()] == [("退货要三天。", 1), ("一。\n二。\n三。", 0), ("", 0)]
