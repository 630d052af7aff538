"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions import text as tx
from heronry.tables import table

_CONTROL = tx.CONTROL
SQL_STRIP = "regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sql_clean(c: str) -> str:
    c = f"translate({c}, '‘’“”– ', '''''\"\"- ')"
    c = f"replace(replace(replace({c}, '—', '--'), '…', '...'), '�', '')"
    c = f"regexp_replace({c}, '{_CONTROL}', '', 'g')"
    c = f"regexp_replace({c}, '(?mi){tx.PAGE_NUMBER}', '', 'g')"
    c = f"regexp_replace({c}, '(?mi){tx.RUNNING_LINE}', '', 'g')"
    c = f"regexp_replace({c}, '[ \\t]+', ' ', 'g')"
    c = f"regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    c = f"regexp_replace({c}, '\\r\\n|[\\r\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?m)^[ \\t\\p{{Z}}]+|[ \\t\\p{{Z}}]+$', '', 'g')"
    return SQL_STRIP.format(c=c)


def q_clean_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.withColumn("clean", tx.clean(F.col("text"))).select("doc_id", F.length("clean").alias("clean_chars"), F.md5("clean").alias("clean_md5"))


def q_clean_pages(spark, d):
    """Pages cleaned and put together per document and page; the size before and after."""
    pages = table(spark, d, "parsed_pages").select("doc_id", "page_num", "text").distinct()
    pages = pages.withColumn("clean", F.coalesce(tx.clean(F.col("text")), F.lit("")))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.sum(F.length("clean")).alias("clean_chars"))


def q_clean_input(spark, d):
    rows = table(spark, d, "chat_messages").select("message_id", "message").distinct()
    rows = rows.withColumn("cleaned", F.coalesce(tx.clean_input(F.col("message")), F.lit("")))
    return rows.select("message_id", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").alias("chars"), tx.token_estimate(F.col("cleaned")).alias("tokens"))


_INPUT = f"""(SELECT message_id, coalesce(regexp_replace(regexp_replace(CASE WHEN length(s) > 1500 THEN substr(s, 1, 1500) || '...' ELSE s END, '[\\s\\p{{Z}}]+', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '') AS cleaned
FROM (SELECT DISTINCT message_id, message, {SQL_STRIP.format(c="message")} AS s FROM chat_messages))"""


def q_normal_form(spark, d):
    items = table(spark, d, "eval_items")
    return items.select("case_id", tx.normal_form(F.col("question")).alias("question"), tx.normal_form(F.col("expected_answer")).alias("answer"))


_PUNCT = "[\\s\\x{3000}\\x{2000}-\\x{206f},，.。!！?？;；:：\"''「」『』()（）\\[\\]【】<>《》/\\\\\\-—_=+*&^%$#@!~`]+"


def sql_normal(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{_PUNCT}', ' ', 'g'))"


def q_key_phrases(spark, d):
    items = table(spark, d, "eval_items")
    return items.select("case_id", F.explode(tx.key_phrases(F.col("expected_answer"))).alias("phrase"))


def sql_phrases(norm: str) -> str:
    flat = f"regexp_replace({norm}, '[^\\x{{4e00}}-\\x{{9fff}}0-9a-z]', '', 'g')"
    grams = " || ".join(f"list_transform(range(1, length({flat}) - {n - 2}), lambda i: substr({flat}, i, {n}))" for n in (2, 3, 4))
    return f"list_distinct(regexp_extract_all({norm}, '[0-9]+(?:\\.[0-9]+)?%?') || {grams})"


def q_json_safe(spark, d):
    """Numbers that JSON cannot hold (NaN, infinite) become 0; null stays."""
    rows = table(spark, d, "requests")
    bad = F.isnan("duration_ms") | (F.abs("duration_ms") == float("inf"))
    return rows.withColumn("safe_ms", F.when(bad, 0.0).otherwise(F.col("duration_ms"))).groupBy("status").agg(
        F.count("*").alias("n"), F.count("safe_ms").alias("n_known"), F.sum((F.coalesce("safe_ms", F.lit(-1.0)) == 0).cast("long")).alias("n_zero"), F.max("safe_ms").alias("largest")
    )


QUERIES = {
    "q_clean_text": (q_clean_text, f"SELECT doc_id, length(c) AS clean_chars, md5(c) AS clean_md5 FROM (SELECT doc_id, {sql_clean('text')} AS c FROM documents)"),
    "q_clean_pages": (
        q_clean_pages,
        f"SELECT doc_id, count(*) AS pages, sum(coalesce(length(text), 0)) AS chars, sum(length(coalesce({sql_clean('text')}, ''))) AS clean_chars FROM (SELECT DISTINCT doc_id, page_num, text FROM parsed_pages) GROUP BY 1",
    ),
    "q_clean_input": (
        q_clean_input,
        f"SELECT message_id, md5(cleaned) AS cleaned_md5, length(cleaned) AS chars, CAST(floor(h * 1.5 + (length(cleaned) - h) * 0.25) AS INTEGER) AS tokens FROM (SELECT *, length(regexp_replace(cleaned, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS h FROM {_INPUT})",
    ),
    "q_normal_form": (q_normal_form, f"SELECT case_id, {sql_normal('question')} AS question, {sql_normal('expected_answer')} AS answer FROM eval_items"),
    "q_key_phrases": (q_key_phrases, f"SELECT case_id, unnest({sql_phrases('n')}) AS phrase FROM (SELECT case_id, {sql_normal('expected_answer')} AS n FROM eval_items)"),
    "q_json_safe": (
        q_json_safe,
        "SELECT status, count(*) AS n, count(s) AS n_known, sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS n_zero, max(s) AS largest FROM (SELECT status, CASE WHEN isnan(duration_ms) OR isinf(duration_ms) THEN 0.0 ELSE duration_ms END AS s FROM requests) GROUP BY 1",
    ),
}
