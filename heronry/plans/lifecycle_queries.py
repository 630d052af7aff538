"""Queries of the document lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import lifecycle as lc
from heronry.plans.reference_queries import _KEY, _ts
from heronry.tables import iso_time, table


def _docs(spark, d):
    return table(spark, d, "parsed_documents")


def q_doc_meta(spark, d):
    return lc.file_meta(_docs(spark, d).distinct())


def q_latest_docs(spark, d):
    return lc.latest(_docs(spark, d)).select("doc_id", "doc_version", "file_hash", "doc_status")


def q_doc_versions(spark, d):
    return lc.versions(_docs(spark, d))


def q_conflict_actions(spark, d):
    """The newest version of each document as an upload against the state before it."""
    docs = lc.numbered(_docs(spark, d).select("doc_id", "doc_version", "file_hash").distinct())
    new, old = docs.where("age = 1"), docs.where("age = 2")
    return lc.conflict_actions(new.select("doc_id", "file_hash"), old)


def q_doc_list(spark, d):
    docs = lc.latest(_docs(spark, d)).where(F.lower("file_type") == "pdf")
    return docs.select("doc_id", "file_name", lc.size_text(F.col("file_size")).alias("size"), F.size(F.coalesce("tags", F.array().cast("array<string>"))).alias("n_tags"), "doc_status")


def q_doc_totals(spark, d):
    return lc.totals(lc.latest(_docs(spark, d)))


def q_delete_docs(spark, d):
    """Parents left when the log's deletions are carried out on them and through their documents."""
    log = table(spark, d, "deletions")
    rows = table(spark, d, "parent_chunks").distinct()
    rows = lc.delete(rows, "parent_id", log.where("target_table = 'parent_chunks'"), "target_key")
    rows = lc.delete(rows, "doc_id", log.where("target_table = 'parsed_documents'"), "target_key")
    return rows.groupBy("doc_id").agg(F.count("*").alias("parents"), F.sum(F.length("content")).alias("chars"))


def q_archive_docs(spark, d):
    """Documents whose newest version is older than 90 days before the newest of all become archived."""
    docs = lc.latest(_docs(spark, d)).withColumn("at", iso_time(F.col("updated_at")))
    limit = docs.agg((F.max("at") - F.expr("interval 90 days")).alias("t")).scalar()
    old = docs.where(F.col("at") < limit).select("doc_id")
    return lc.set_status(docs, old, "archived").groupBy("doc_status").agg(F.count("*").alias("docs"))


def q_upsert_parents(spark, d):
    """The newest rows of a parent key replace the older ones."""
    rows = table(spark, d, "parent_chunks").distinct()
    new = rows.where("heading_level >= 2")
    return lc.upsert(rows, new, ["doc_id", "parent_id"]).groupBy("heading_level").agg(F.count("*").alias("rows"))


def q_tagged_docs(spark, d):
    docs = lc.latest(_docs(spark, d))
    return docs.where("doc_status <> 'archived'").select(F.explode("tags").alias("tag"), "doc_id").groupBy("tag").agg(F.countDistinct("doc_id").alias("docs"))


def q_children_of_docs(spark, d):
    rows = table(spark, d, "child_chunks").distinct()
    return rows.groupBy("doc_id").agg(F.count("*").alias("children"), F.countDistinct("chapter_id").alias("chapters"), F.max("chunk_index").alias("last_index"))


_LATEST = f"lt AS (SELECT * FROM parsed_documents WHERE {_KEY.format(c='doc_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_KEY.format(c='doc_id')} ORDER BY doc_version DESC, {_ts('updated_at')} DESC, file_hash DESC) = 1)"
_PKEY = _KEY.format(c="parent_id")
_DKEY = _KEY.format(c="doc_id")
_TKEY = _KEY.format(c="target_key")

QUERIES = {
    "q_doc_meta": (
        q_doc_meta,
        "SELECT substr(md5(file_path), 1, 12) AS path_id, sha256(coalesce(raw_text, '')) AS content_hash, CAST(strlen(coalesce(raw_text, '')) AS BIGINT) AS bytes, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS ext FROM (SELECT DISTINCT * FROM parsed_documents)",
    ),
    "q_latest_docs": (q_latest_docs, f"WITH {_LATEST} SELECT doc_id, doc_version, file_hash, doc_status FROM lt"),
    "q_doc_versions": (q_doc_versions, "SELECT doc_id, doc_version, count(*) AS rows, min(operator) AS operator, min(file_hash) AS file_hash FROM (SELECT DISTINCT doc_id, doc_version, operator, file_hash FROM parsed_documents) GROUP BY 1, 2"),
    "q_conflict_actions": (
        q_conflict_actions,
        "WITH v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_version DESC, file_hash) AS age FROM (SELECT DISTINCT doc_id, doc_version, file_hash FROM parsed_documents)), j AS (SELECT n.doc_id, o.doc_version AS kv, CASE WHEN o.doc_version IS NULL THEN 'create' WHEN n.file_hash = o.file_hash THEN 'skip' ELSE 'overwrite' END AS action FROM (SELECT * FROM v WHERE age = 1) n LEFT JOIN (SELECT * FROM v WHERE age = 2) o USING (doc_id)) SELECT doc_id, action, CAST(CASE action WHEN 'create' THEN 1 WHEN 'skip' THEN kv ELSE kv + 1 END AS INTEGER) AS version FROM j",
    ),
    "q_doc_list": (
        q_doc_list,
        f"WITH {_LATEST} SELECT doc_id, file_name, CASE WHEN file_size < 1024 THEN file_size || 'B' WHEN file_size < 1048576 THEN (file_size // 1024) || 'KB' ELSE (file_size // 1048576) || 'MB' END AS size, coalesce(len(tags), 0) AS n_tags, doc_status FROM lt WHERE lower(file_type) = 'pdf'",
    ),
    "q_doc_totals": (q_doc_totals, f"WITH {_LATEST} SELECT file_type, doc_status, count(*) AS docs, sum(vector_count) AS vectors, sum(file_size) AS bytes FROM lt GROUP BY ROLLUP (file_type, doc_status)"),
    "q_delete_docs": (
        q_delete_docs,
        f"SELECT doc_id, count(*) AS parents, sum(length(content)) AS chars FROM (SELECT DISTINCT * FROM parent_chunks) WHERE ({_PKEY} IS NULL OR {_PKEY} NOT IN (SELECT {_TKEY} FROM deletions WHERE target_table = 'parent_chunks' AND {_TKEY} IS NOT NULL)) AND ({_DKEY} IS NULL OR {_DKEY} NOT IN (SELECT {_TKEY} FROM deletions WHERE target_table = 'parsed_documents' AND {_TKEY} IS NOT NULL)) GROUP BY 1",
    ),
    "q_archive_docs": (
        q_archive_docs,
        f"WITH {_LATEST}, t AS (SELECT *, {_ts('updated_at')} AS u FROM lt) SELECT CASE WHEN u < (SELECT max(u) - INTERVAL 90 DAY FROM t) THEN 'archived' ELSE doc_status END AS doc_status, count(*) AS docs FROM t GROUP BY 1",
    ),
    "q_upsert_parents": (
        q_upsert_parents,
        "WITH r AS (SELECT DISTINCT * FROM parent_chunks), n AS (SELECT * FROM r WHERE heading_level >= 2) SELECT heading_level, count(*) AS rows FROM (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = r.doc_id AND n.parent_id = r.parent_id) UNION ALL SELECT * FROM n) GROUP BY 1",
    ),
    "q_tagged_docs": (q_tagged_docs, f"WITH {_LATEST} SELECT tag, count(DISTINCT doc_id) AS docs FROM (SELECT unnest(tags) AS tag, doc_id FROM lt WHERE doc_status <> 'archived') GROUP BY 1"),
    "q_children_of_docs": (q_children_of_docs, "SELECT doc_id, count(*) AS children, count(DISTINCT chapter_id) AS chapters, max(chunk_index) AS last_index FROM (SELECT DISTINCT * FROM child_chunks) GROUP BY 1"),
}
