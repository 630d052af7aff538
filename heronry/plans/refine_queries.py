"""Queries that shorten texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import refine as rf
from heronry.operators.retrieval import parents_of, top
from heronry.plans.retrieval_queries import _CHILD, _PAR, _WEIGHTS, _hits_sql, _qw_sql, _sparse
from heronry.tables import table


def q_rule_clean(spark, d):
    rows = table(spark, d, "parsed_pages").select("doc_id", "page_num", "text").distinct().where("text is not null")
    rows = rows.withColumn("clean", rf.rule_clean(F.col("text")))
    return rows.select("doc_id", "page_num", F.length("clean").alias("chars"), F.md5("clean").alias("clean_md5"))


def q_parent_summary(spark, d):
    rows = table(spark, d, "parent_chunks").select("parent_id", "content").distinct().where("content is not null")
    return rows.select("parent_id", F.md5(rf.summary(F.col("content"))).alias("summary_md5"))


def q_answering_sentences(spark, d):
    """The three best parents of each question, shortened to the sentences that hold a word of it."""
    hits = _sparse(spark, d, 30, "child_chunks", "child_id", "content")
    best = top(parents_of(hits, table(spark, d, "child_chunks")), 3, tie="parent_id").select("query_id", "parent_id", "rank")
    texts = table(spark, d, "parent_chunks").select("parent_id", "content").distinct()
    asked = table(spark, d, "eval_items").select(F.col("case_id").alias("query_id"), "question")
    rows = rf.answering(best.join(texts, "parent_id").join(asked, "query_id"), "question", "content")
    return rows.select("query_id", "parent_id", "rank", "n_hits", F.length("refined").alias("chars"))


_STRIP = "list_transform({l}, lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_LINES = _STRIP.format(l="string_split(text, chr(10))")
_SENT = "list_filter(" + _STRIP.format(l="string_split(replace(content, chr(10), '。'), '。')") + ", lambda x: x <> '')"
_WORDS = "list_distinct(list_filter(string_split_regex(question, '[，。！？；：、\\s,.!?;:\\-]+'), lambda w: length(w) >= 2))"
_PARTS = "list_filter(" + _STRIP.format(l="regexp_extract_all(coalesce(content, ''), '[^。！？.!?;；\\n]+[。！？.!?;；]*')") + ", lambda x: x <> '')"

QUERIES = {
    "q_rule_clean": (
        q_rule_clean,
        f"""WITH p AS (SELECT DISTINCT doc_id, page_num, text FROM parsed_pages WHERE text IS NOT NULL), l AS (SELECT doc_id, page_num, text, {_LINES} AS ls FROM p),
k AS (SELECT doc_id, page_num, array_to_string(list_transform(list_filter(list_filter(ls, lambda x, i: x <> '' OR i = 1 OR ls[i - 1] <> ''), lambda x: NOT regexp_matches(x, '^[0-9]{{1,4}}$') AND NOT regexp_matches(x, '(?i)^(?:第\\s*[0-9]+\\s*页|Page\\s+[0-9]+|-\\s*[0-9]+\\s*-)$')), lambda x: regexp_replace(x, '\\s{{2,}}', ' ', 'g')), chr(10)) AS c FROM l)
SELECT doc_id, page_num, length(c) AS chars, md5(c) AS clean_md5 FROM k""",
    ),
    "q_parent_summary": (
        q_parent_summary,
        f"""WITH p AS (SELECT DISTINCT parent_id, content FROM parent_chunks WHERE content IS NOT NULL), s AS (SELECT parent_id, content, {_SENT} AS s FROM p),
m AS (SELECT *, list_max(list_transform(s[2:len(s) - 1], lambda x: length(x))) AS n FROM s),
o AS (SELECT *, list_filter(s[2:len(s) - 1], lambda x: length(x) = n)[1] AS mid FROM m)
SELECT parent_id, md5(CASE WHEN len(s) > 3 THEN substr(s[1], 1, 100) || '。' || CASE WHEN n > 20 THEN substr(mid, 1, 100) || '。' ELSE '' END || substr(s[-1], 1, 100) || '。' ELSE substr(content, 1, 300) END) AS summary_md5 FROM o""",
    ),
    "q_answering_sentences": (
        q_answering_sentences,
        f"""WITH {_CHILD}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(30)}, {_PAR},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM par QUALIFY rank <= 3),
x AS (SELECT b.query_id, b.parent_id, b.rank, {_WORDS} AS w, {_PARTS} AS s FROM best b JOIN (SELECT DISTINCT parent_id, content FROM parent_chunks) c USING (parent_id) JOIN eval_items e ON e.case_id = b.query_id),
h AS (SELECT *, list_filter(s, lambda y: len(list_filter(w, lambda z: contains(y, z))) > 0) AS h FROM x)
SELECT query_id, parent_id, rank, CAST(len(h) AS INTEGER) AS n_hits, length(array_to_string(CASE WHEN len(h) > 0 THEN h ELSE s[1:3] END, chr(10))) AS chars FROM h""",
    ),
}
