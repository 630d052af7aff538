"""Queries of search: the evaluation questions against documents and chunks, vectors against vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions.text import STOP_WORDS
from heronry.operators import retrieval as rt
from heronry.tables import kept, staged, table

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_RUNS = "regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')"


def _sql_tokens(t: str) -> str:
    words = f"list_filter(regexp_extract_all({t}, '[A-Za-z0-9]+'), lambda w: length(w) >= 2 AND regexp_matches(w, '[A-Za-z]'))"
    pairs = f"list_filter(flatten(list_transform({_RUNS.format(t=t)}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), lambda p: NOT list_contains({_STOP}, p))"
    return f"({words} || {pairs})"


def _terms_sql(id_: str, src: str, text: str) -> str:
    return f"""tok AS (SELECT {id_} AS id, {_sql_tokens(text)} AS a FROM {src} WHERE {text} IS NOT NULL),
terms AS (SELECT id, token, count(*) * 1.0 / any_value(len) AS tf FROM (SELECT id, len(a) AS len, unnest(a) AS token FROM tok) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM terms GROUP BY 1), nn AS (SELECT count(DISTINCT id) AS n FROM terms)"""


_WEIGHTS = """w AS (SELECT id, token, round(tf * 2.5 / (tf + 1.5) * (ln((n + 1) / (df + 1)) + 1), 9) AS weight FROM terms JOIN df USING (token), nn
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, token) <= 128)"""


def _qw_sql() -> str:
    return f"qw AS (SELECT case_id AS query_id, token, round(ln((n + 1) / (df + 1)) + 1, 9) AS qw FROM (SELECT DISTINCT case_id, unnest({_sql_tokens('question')}) AS token FROM eval_items) JOIN df USING (token), nn)"


def _hits_sql(k: int) -> str:
    return f"""s AS (SELECT query_id, id, round(sum(qw * weight), 6) AS score FROM qw JOIN w USING (token) GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k})"""


def _index(spark, d, name: str = "documents", id_col: str = "doc_id", text: str = "text"):
    """Terms, document frequencies and number of texts; kept for the state of the table, so that queries share them."""
    rows = table(spark, d, name)
    terms = kept(rows, f"terms-{name}-{text}", lambda: rt.term_counts(rows.select(id_col, text).distinct(), id_col, text))
    df = kept(rows, f"frequencies-{name}-{text}", lambda: rt.document_frequency(terms))
    return terms, df, terms.agg(F.countDistinct("id").alias("n")).scalar()


def _weights(spark, d, name: str = "documents", id_col: str = "doc_id", text: str = "text"):
    terms, df, n = _index(spark, d, name, id_col, text)
    return kept(table(spark, d, name), f"weights-{name}-{text}", lambda: rt.weights(terms, df, n))


def q_vocabulary(spark, d):
    return rt.document_frequency(rt.term_counts(table(spark, d, "documents"), "doc_id", "text"))


def q_vocabulary_stats(spark, d):
    terms = rt.term_counts(table(spark, d, "documents"), "doc_id", "text")
    df = rt.document_frequency(terms).agg(F.count("*").alias("vocabulary"), F.round(F.avg("df"), 4).alias("avg_df"))
    return df.withColumn("n_texts", terms.agg(F.countDistinct("id").alias("n")).scalar())


def q_term_weights(spark, d):
    w = _weights(spark, d)
    return w.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"), F.max("weight").alias("heaviest"))


def q_query_weights(spark, d):
    _, df, n = _index(spark, d)
    return rt.query_weights(table(spark, d, "eval_items"), "case_id", "question", df, n)


def _sparse(spark, d, k: int, name: str = "documents", id_col: str = "doc_id", text: str = "text"):
    _, df, n = _index(spark, d, name, id_col, text)
    q = rt.query_weights(table(spark, d, "eval_items"), "case_id", "question", df, n)
    # only tokens that some question has can score
    asked = q.select("token").distinct()
    return rt.sparse_search(q, _weights(spark, d, name, id_col, text).join(asked, "token", "left_semi"), k)


def q_sparse_topk(spark, d):
    return _sparse(spark, d, 8)


def _vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.where("vec_id % 100 = 0"), rows


def q_dense_topk(spark, d):
    """Every vector whose id is divisible by 100 as a query, against all vectors."""
    q, rows = _vectors(spark, d)
    return rt.dense_search(q, rows, "vec_id", "embedding", 10)


def q_dense_dot_topk(spark, d):
    q, rows = _vectors(spark, d)
    return rt.dense_search(q, rows, "vec_id", "embedding", 10, "dot")


def q_rank_fusion(spark, d):
    q, rows = _vectors(spark, d)
    return rt.fuse(rt.dense_search(q, rows, "vec_id", "embedding", 20), rt.dense_search(q, rows, "vec_id", "embedding", 20, "dot"), 10)


def q_score_filter(spark, d):
    q, rows = _vectors(spark, d)
    return rt.keep_good(rt.dense_search(q, rows, "vec_id", "embedding", 10), 0.35, 0.5, 2)


def q_chunk_parents(spark, d):
    """Questions against child chunks, then the parents of the hits with their best score."""
    hits = _sparse(spark, d, 30, "child_chunks", "child_id", "content")
    return rt.parents_of(hits, table(spark, d, "child_chunks"))


def q_sibling_parents(spark, d):
    hits = _sparse(spark, d, 3, "child_chunks", "child_id", "content")
    found = staged(rt.parents_of(hits, table(spark, d, "child_chunks")), "parents")
    return rt.siblings(found, table(spark, d, "parent_chunks")).groupBy("query_id").agg(F.count("*").alias("n_siblings"), F.countDistinct("prefix").alias("n_prefixes"))


def q_context_budget(spark, d):
    hits = _sparse(spark, d, 8)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    parts = rt.within_budget(hits.join(docs, "id"), 600, 4000)
    return parts.select("query_id", "id", "rank", F.length("context").alias("chars"))


def q_same_start(spark, d):
    return rt.same_start(table(spark, d, "parent_chunks"))


def q_children_listed(spark, d):
    """Reverse look-up: the lists of children in the parents, opened, against the children's own references."""
    p = table(spark, d, "parent_chunks").select("parent_id", F.explode(F.from_json("child_ids", "array<string>")).alias("child_id")).distinct()
    c = table(spark, d, "child_chunks").select("child_id", F.col("parent_id").alias("own_parent")).distinct()
    return p.join(c, "child_id", "left").groupBy((F.col("own_parent") == F.col("parent_id")).alias("own"), F.col("own_parent").isNull().alias("no_child")).agg(F.count("*").alias("n"))


_DOC = _terms_sql("doc_id", "documents", "text")
_CHILD = _terms_sql("child_id", "(SELECT DISTINCT child_id, content FROM child_chunks)", "content")
_DENSE = """p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.v, e.v), 6) AS dot,
  round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)), 6) AS cos
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e),
cr AS (SELECT query_id, id, cos AS score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM p),
dr AS (SELECT query_id, id, dot AS score, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS rank FROM p)"""
_PAR = "par AS (SELECT query_id, parent_id, max(score) AS score, count(*) AS n_hits FROM hits JOIN (SELECT DISTINCT child_id AS id, parent_id FROM child_chunks WHERE trim(parent_id) <> '') USING (id) GROUP BY 1, 2)"

QUERIES = {
    "q_sparse_topk": (q_sparse_topk, f"WITH {_DOC}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(8)} SELECT * FROM hits"),
    "q_vocabulary": (q_vocabulary, f"WITH {_DOC} SELECT * FROM df"),
    "q_vocabulary_stats": (q_vocabulary_stats, f"WITH {_DOC} SELECT count(*) AS vocabulary, round(avg(df), 4) AS avg_df, any_value(n) AS n_texts FROM df, nn"),
    "q_term_weights": (q_term_weights, f"WITH {_DOC}, {_WEIGHTS} SELECT id, count(*) AS n_terms, round(sum(weight), 5) AS total, max(weight) AS heaviest FROM w GROUP BY 1"),
    "q_query_weights": (q_query_weights, f"WITH {_DOC}, {_qw_sql()} SELECT query_id, token, qw AS weight FROM qw"),
    "q_dense_topk": (q_dense_topk, f"WITH {_DENSE} SELECT * FROM cr WHERE rank <= 10"),
    "q_dense_dot_topk": (q_dense_dot_topk, f"WITH {_DENSE} SELECT * FROM dr WHERE rank <= 10"),
    "q_rank_fusion": (
        q_rank_fusion,
        f"WITH {_DENSE}, f AS (SELECT query_id, id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM (SELECT * FROM cr WHERE rank <= 20) a FULL JOIN (SELECT * FROM dr WHERE rank <= 20) b USING (query_id, id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10",
    ),
    "q_score_filter": (
        q_score_filter,
        f"WITH {_DENSE}, t AS (SELECT * FROM cr WHERE rank <= 10), g AS (SELECT *, score >= 0.35 AND score >= 0.5 * max(score) OVER (PARTITION BY query_id) AS good FROM t), n AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS k FROM g) SELECT query_id, id, score, rank FROM n WHERE (good AND k >= 2) OR (k < 2 AND rank <= 2)",
    ),
    "q_chunk_parents": (q_chunk_parents, f"WITH {_CHILD}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(30)}, {_PAR} SELECT * FROM par"),
    "q_sibling_parents": (
        q_sibling_parents,
        f"""WITH {_CHILD}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(3)}, {_PAR},
pre AS (SELECT DISTINCT parent_id, doc_id, array_to_string(list_slice(string_split(chapter_title, ' · '), 1, len(string_split(chapter_title, ' · ')) - 1), ' · ') AS prefix FROM parent_chunks WHERE chapter_title IS NOT NULL AND len(string_split(chapter_title, ' · ')) > 1),
st AS (SELECT DISTINCT query_id, doc_id, prefix FROM par JOIN pre USING (parent_id)),
nr AS (SELECT DISTINCT st.query_id, pre.parent_id, pre.prefix FROM st JOIN pre USING (doc_id, prefix))
SELECT query_id, count(*) AS n_siblings, count(DISTINCT prefix) AS n_prefixes FROM nr WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.query_id = nr.query_id AND par.parent_id = nr.parent_id) GROUP BY 1""",
    ),
    "q_context_budget": (
        q_context_budget,
        f"WITH {_DOC}, {_WEIGHTS}, {_qw_sql()}, {_hits_sql(8)}, c AS (SELECT query_id, id, rank, CASE WHEN length(text) > 600 THEN 603 ELSE length(text) END AS chars FROM hits JOIN documents ON doc_id = id), b AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT query_id, id, rank, chars FROM b WHERE before < 4000",
    ),
    "q_same_start": (
        q_same_start,
        "SELECT min(parent_id) AS parent_id, count(*) AS copies FROM (SELECT DISTINCT parent_id, doc_id, substr(regexp_replace(content, '[\\s\\p{Z}]+', '', 'g'), 1, 300) AS sign FROM parent_chunks) WHERE sign <> '' GROUP BY sign",
    ),
    "q_children_listed": (
        q_children_listed,
        "WITH p AS (SELECT DISTINCT parent_id, unnest(from_json(child_ids, '[\"VARCHAR\"]')) AS child_id FROM parent_chunks), c AS (SELECT DISTINCT child_id, parent_id AS own_parent FROM child_chunks) SELECT own_parent = p.parent_id AS own, own_parent IS NULL AS no_child, count(*) AS n FROM p LEFT JOIN c USING (child_id) GROUP BY 1, 2",
    ),
}
