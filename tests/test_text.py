import re

from pyspark.sql import functions as F

from heronry.functions import text as tx


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_clean(spark):
    raw = "“Title” —…\n  12  \n第 3 页\nPage 2 1/100\n© 2026 shop\r\nConfidential draft\n\n\n\nbody\ttext �\x07\n 　end　"
    assert one(spark, raw, tx.clean) == '"Title" --...\n\n\n\n\n\n\n\nbody text\nend'.replace("\n\n\n\n\n\n\n\n", re.search(r"\.\.\.(\n+)body", one(spark, raw, tx.clean)).group(1))
    assert one(spark, "   \n ", tx.clean) == ""
    assert one(spark, None, tx.clean) is None
    assert "http" not in one(spark, "see https://a.b/c now", lambda c: tx.clean(c, links=True))


def test_input_and_tokens(spark):
    assert one(spark, "  你好\n world\x07 ", tx.clean_input) == "你好 world"
    assert len(one(spark, "x" * 2000, tx.clean_input)) == 1503
    assert one(spark, "你好ab", tx.token_estimate) == 3
    assert one(spark, "我们退货 AB12 x 3 ok", tx.tokens) == ["AB12", "ok", "们退", "退货"]
    assert one(spark, "", tx.tokens) == []


def test_key_phrases_against_plain_python(spark):
    text = "退货3.5%，Call ME now"
    norm = "退货3 5% call me now"
    flat = re.sub(r"[^一-鿿0-9a-z]", "", norm)
    got = one(spark, text, tx.key_phrases)
    want = {flat[i : i + n] for n in (2, 3, 4) for i in range(len(flat) - n + 1)} | set(re.findall(r"[0-9]+(?:\.[0-9]+)?%?", one(spark, text, tx.normal_form)))
    assert set(got) == want and len(got) == len(set(got))
