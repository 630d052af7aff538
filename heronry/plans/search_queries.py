"""Queries of the whole search: the evaluation questions over documents and over chunks of active documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import retrieval as rt
from heronry.operators import search as se
from heronry.plans.retrieval_queries import _CHILD, _DOC, _PAR, _WEIGHTS, _hits_sql, _index, _qw_sql, _sparse, _weights
from heronry.tables import staged, table


def _hybrid(spark, d, k: int):
    """Documents in Chinese only: the filter stands before both arms."""
    _, df, n = _index(spark, d)
    q = staged(rt.query_weights(table(spark, d, "eval_items"), "case_id", "question", df, n), "asked")
    allowed = table(spark, d, "documents").where(F.lower(F.trim("lang")).startswith("zh")).select(F.col("doc_id").alias("id"))
    w = staged(_weights(spark, d).join(allowed, "id", "left_semi"), "weights")
    return se.hybrid_search(q, w, k)


def q_hybrid_search(spark, d):
    return _hybrid(spark, d, 8)


def _found(spark, d):
    """Parents of the 30 best chunks of each question, without doubles."""
    hits = staged(_sparse(spark, d, 30, "child_chunks", "child_id", "content"), "hits")
    link = table(spark, d, "child_chunks").select(F.col("child_id").alias("id"), "parent_id").where("trim(parent_id) <> ''").distinct()
    per = hits.join(link, "id").groupBy("query_id", "parent_id").agg(F.max("score").alias("best"), F.round(F.sum("score"), 6).alias("total"), F.count("*").alias("n"))
    parents = table(spark, d, "parent_chunks").select("parent_id", "content", "chapter_title").distinct()
    return per.join(parents, "parent_id")


def q_parents_without_doubles(spark, d):
    return se.without_doubles(_found(spark, d))


def q_contexts(spark, d):
    """The three best parents of each question as one context."""
    found = staged(_found(spark, d), "found")
    kept = se.without_doubles(found).where("place <= 3")
    texts = found.groupBy("query_id", "parent_id").agg(F.min("content").alias("content"), F.min("chapter_title").alias("title"))
    out = se.contexts(kept.join(texts, ["query_id", "parent_id"]))
    return out.select("query_id", "n_sources", F.length("context").alias("chars"), F.md5("context").alias("context_md5"))


def _doc_hits(spark, d, k: int):
    hits = _sparse(spark, d, k)
    return hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")


def q_quoted_hits(spark, d):
    asked = table(spark, d, "eval_items").select(F.col("case_id").alias("query_id"))
    out = se.quoted(_doc_hits(spark, d, 8), asked)
    return out.select("query_id", "n_quotes", F.md5("answer").alias("answer_md5"))


def q_hit_keywords(spark, d):
    return se.keywords(_doc_hits(spark, d, 3))


_VEC = """vec AS (SELECT id, dim, sum(weight * sgn) AS x FROM (SELECT id, weight, ('0x' || substr(md5(token), 1, 4))::INTEGER % 64 AS dim, CASE WHEN ('0x' || substr(md5(token), 1, 4))::INTEGER >= 32768 THEN -1 ELSE 1 END AS sgn FROM {src}) GROUP BY 1, 2)"""
_HYB = f"""wz AS (SELECT w.* FROM w JOIN documents ON doc_id = id WHERE starts_with(lower(trim(lang)), 'zh')), {_VEC.format(src='wz').replace('vec AS', 'vd AS')},
qz AS (SELECT query_id AS id, token, qw AS weight FROM qw), {_VEC.format(src='qz').replace('vec AS', 'vq AS')},
nd AS (SELECT id, sqrt(sum(x * x)) AS len FROM vd GROUP BY 1), nq AS (SELECT id, sqrt(sum(x * x)) AS len FROM vq GROUP BY 1),
cs AS (SELECT q.id AS query_id, e.id, round(sum(q.x * e.x) / any_value(nq.len) / any_value(nd.len), 6) AS score FROM vq q JOIN vd e USING (dim) JOIN nq ON nq.id = q.id JOIN nd ON nd.id = e.id WHERE nd.len > 0 AND nq.len > 0 GROUP BY 1, 2),
za AS (SELECT nq.id AS query_id, nd.id, coalesce(cs.score, 0.0) AS score FROM nq CROSS JOIN nd LEFT JOIN cs ON cs.query_id = nq.id AND cs.id = nd.id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM za QUALIFY rank <= 16),
sp AS (SELECT query_id, id, round(sum(qw * weight), 6) AS score FROM qw JOIN wz USING (token) GROUP BY 1, 2), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp QUALIFY rank <= 16),
fu AS (SELECT query_id, id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM sr a FULL JOIN dr b USING (query_id, id))"""
_PARENTS = f"""WITH {_CHILD}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(30)},
per AS (SELECT query_id, parent_id, max(score) AS best, round(sum(score), 6) AS total, count(*) AS n FROM hits JOIN (SELECT DISTINCT child_id AS id, parent_id FROM child_chunks WHERE trim(parent_id) <> '') USING (id) GROUP BY 1, 2),
fd AS (SELECT query_id, parent_id, min(content) AS content, min(chapter_title) AS title, max(round(best * 100 + total + n, 6)) AS p FROM per JOIN (SELECT DISTINCT parent_id, content, chapter_title FROM parent_chunks) USING (parent_id) GROUP BY 1, 2),
sg AS (SELECT query_id, parent_id, p, substr(regexp_replace(content, '[\\s\\p{{Z}}]+', '', 'g'), 1, 300) AS sign FROM fd),
ls AS (SELECT query_id, list(struct_pack(ids := [parent_id], signs := [sign]) ORDER BY p DESC, parent_id) AS e FROM sg WHERE sign <> '' GROUP BY 1),
fo AS (SELECT query_id, list_reduce(e, lambda a, x: CASE WHEN len(list_filter(a.signs, lambda y: y = x.signs[1] OR (length(x.signs[1]) >= 50 AND contains(y, substr(x.signs[1], 1, 150))) OR (length(y) >= 50 AND contains(x.signs[1], substr(y, 1, 150))))) > 0 THEN a ELSE struct_pack(ids := list_append(a.ids, x.ids[1]), signs := list_append(a.signs, x.signs[1])) END) AS k FROM ls),
kept AS (SELECT query_id, unnest(k.ids) AS parent_id, CAST(generate_subscripts(k.ids, 1) AS INTEGER) AS place FROM fo)"""

QUERIES = {
    "q_hybrid_search": (q_hybrid_search, f"WITH {_DOC}, {_WEIGHTS}, {_qw_sql()}, {_HYB} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu QUALIFY rank <= 8"),
    "q_parents_without_doubles": (q_parents_without_doubles, f"{_PARENTS} SELECT * FROM kept"),
    "q_contexts": (
        q_contexts,
        f"""{_PARENTS}, pt AS (SELECT query_id, place, '[来源 ' || place || ']' || CASE WHEN coalesce(title, '') <> '' THEN ' 章节: ' || title ELSE '' END || chr(10) || CASE WHEN length(content) > 4000 THEN substr(content, 1, 4000) || chr(10) || '...(内容过长，已截断)' ELSE content END AS part FROM kept JOIN fd USING (query_id, parent_id) WHERE place <= 3),
cx AS (SELECT query_id, count(*) AS n_sources, string_agg(part, chr(10) || chr(10) ORDER BY place) AS context FROM pt GROUP BY 1) SELECT query_id, n_sources, length(context) AS chars, md5(context) AS context_md5 FROM cx""",
    ),
    "q_quoted_hits": (
        q_quoted_hits,
        f"""WITH {_DOC}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(8)}, g AS (SELECT query_id, count(*) AS n, string_agg('[文档' || rank || ']' || chr(10) || substr(text, 1, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS t FROM hits JOIN documents ON doc_id = id WHERE score >= 0.3 GROUP BY 1)
SELECT e.case_id AS query_id, coalesce(n, 0) AS n_quotes, md5(coalesce(t, '{se.NO_ANSWER}')) AS answer_md5 FROM (SELECT DISTINCT case_id FROM eval_items) e LEFT JOIN g ON g.query_id = e.case_id""",
    ),
    "q_hit_keywords": (
        q_hit_keywords,
        f"""WITH {_DOC}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(3)}, k AS (SELECT query_id, unnest(string_split_regex(text, '[，。！？；：、\\s,.!?;:\\-]+')) AS word FROM hits JOIN documents ON doc_id = id), c AS (SELECT query_id, word, count(*) AS n FROM k WHERE length(word) BETWEEN 2 AND 15 GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, word) <= 10""",
    ),
}
