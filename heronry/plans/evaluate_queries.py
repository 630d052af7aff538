"""Queries of answer quality: the best document found for a question stands for the answer, the five best are the contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import evaluate as ev
from heronry.plans.retrieval_queries import _DOC, _WEIGHTS, _hits_sql, _qw_sql, _sparse
from heronry.plans.text_queries import sql_normal, sql_phrases
from heronry.tables import staged, table


def _cases(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = _sparse(spark, d, 5).join(docs, "id")
    found = hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("contexts"),
        F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("answer"),
    )
    items = table(spark, d, "eval_items").withColumnRenamed("case_id", "query_id")
    return staged(items.join(found, "query_id", "left").withColumn("reference", F.col("expected_answer")), "cases")


def q_rule_metrics(spark, d):
    return ev.rule_metrics(_cases(spark, d)).select("query_id", *ev.METRICS, "score")


def q_eval_summary(spark, d):
    return ev.summary(ev.rule_metrics(_cases(spark, d)))


def q_eval_bands(spark, d):
    return ev.rule_metrics(_cases(spark, d)).groupBy(ev.band(F.col("score")).alias("band"), "difficulty").agg(F.count("*").alias("cases"))


def q_keyword_hits(spark, d):
    return ev.keyword_hits(_cases(spark, d)).select("query_id", "expected_hits", "forbidden_hits")


def _cover(p: str, t: str) -> str:
    return f"CASE WHEN len({p}) > 0 AND {t} <> '' THEN round(len(list_filter({p}, lambda x: contains({t}, x))) / len({p}), 4) ELSE 0.5 END"


_CASES = f"""{_DOC}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(5)},
f AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS contexts, max(CASE WHEN rank = 1 THEN text END) AS answer FROM hits JOIN documents ON doc_id = id GROUP BY 1),
c AS (SELECT e.*, case_id AS query_id, coalesce(contexts, '') AS contexts, coalesce(answer, '') AS answer FROM eval_items e LEFT JOIN f ON case_id = f.query_id)"""
_SCORED = f"""{_CASES}, n AS (SELECT *, {sql_normal('contexts')} AS nc, {sql_normal('answer')} AS na, {sql_normal('question')} AS nq, {sql_normal('expected_answer')} AS nr FROM c),
p AS (SELECT *, {sql_phrases('nq')} AS pq, {sql_phrases('na')} AS pa, {sql_phrases('nr')} AS pr FROM n),
m AS (SELECT *, {_cover('pa', 'nc')} AS faithfulness, {_cover('pq', 'nc')} AS context_precision, {_cover('pr', 'na')} AS contextualrecall, {_cover('pq', 'na')} AS answer_relevancy FROM p),
z AS (SELECT *, round((faithfulness + context_precision + contextualrecall + answer_relevancy) / 4, 6) AS score FROM m)"""
_AVGS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in (*ev.METRICS, "score"))

QUERIES = {
    "q_rule_metrics": (q_rule_metrics, f"WITH {_SCORED} SELECT query_id, {', '.join(ev.METRICS)}, score FROM z"),
    "q_eval_summary": (q_eval_summary, f"WITH {_SCORED} SELECT category, count(*) AS cases, {_AVGS} FROM z GROUP BY ROLLUP (category)"),
    "q_eval_bands": (
        q_eval_bands,
        f"WITH {_SCORED} SELECT CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' WHEN score > 0 THEN 'poor' ELSE 'none' END AS band, difficulty, count(*) AS cases FROM z GROUP BY 1, 2",
    ),
    "q_keyword_hits": (
        q_keyword_hits,
        f"WITH {_CASES} SELECT query_id, CAST(len(list_filter(coalesce(expected_keywords, []), lambda w: contains(answer, w))) AS INTEGER) AS expected_hits, CAST(len(list_filter(coalesce(forbidden_keywords, []), lambda w: contains(answer, w))) AS INTEGER) AS forbidden_hits FROM c",
    ),
}
