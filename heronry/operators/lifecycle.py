"""Versions of documents: what exists, what an upload would do, and tables after deletions and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.tables import iso_time, ref_key


def file_meta(docs: DataFrame, path: str = "file_path", content: str = "raw_text") -> DataFrame:
    """Id from the path, hash and size of the content, type from the name."""
    return docs.select(
        F.substring(F.md5(F.col(path)), 1, 12).alias("path_id"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"),
        F.octet_length(F.coalesce(F.col(content), F.lit(""))).cast("long").alias("bytes"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("ext"),
    )


def latest(docs: DataFrame) -> DataFrame:
    """The newest version of each document: an aggregate on (version, time), not a sort of every group."""
    keyed = docs.withColumn("key", ref_key(F.col("doc_id"))).where("key is not null")
    cols = [c for c in keyed.columns if c != "key"]
    newest = keyed.groupBy("key").agg(F.max_by(F.struct(*cols), F.struct("doc_version", iso_time(F.col("updated_at")), "file_hash")).alias("row"))
    return newest.select("row.*")


def versions(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "doc_version", "operator", "file_hash").distinct().groupBy("doc_id", "doc_version").agg(F.count("*").alias("rows"), F.min("operator").alias("operator"), F.min("file_hash").alias("file_hash"))


def conflict_actions(incoming: DataFrame, known: DataFrame, policy: str = "overwrite", skip_unchanged: bool = True) -> DataFrame:
    """doc_id, action, version for uploads (doc_id, file_hash) against the newest known versions: create, skip,
    reject, overwrite or keep_both; an unknown policy overwrites."""
    k = known.select("doc_id", F.col("doc_version").alias("known_version"), F.col("file_hash").alias("known_hash"))
    same = (F.col("file_hash") == F.col("known_hash")) & F.lit(skip_unchanged)
    rule = policy if policy in ("reject", "keep_both") else "overwrite"
    action = F.when(F.col("known_version").isNull(), "create").when(same, "skip").otherwise(rule)
    version = F.when(action == "create", 1).when(action.isin("skip", "reject"), F.col("known_version")).otherwise(F.col("known_version") + 1)
    return incoming.join(k, "doc_id", "left").select("doc_id", action.alias("action"), version.cast("int").alias("version"))


def delete(rows: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """rows without those whose key is named in ``gone``; rows without a key stay."""
    keys = gone.select(ref_key(F.col(gone_key)).alias("__key")).where("__key is not null").distinct()
    return rows.join(keys, ref_key(F.col(key)) == F.col("__key"), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def set_status(docs: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    hit = ids.select("doc_id", F.lit(True).alias("__hit")).distinct()
    return docs.join(hit, "doc_id", "left").withColumn("doc_status", F.when(F.col("__hit"), status).otherwise(F.col("doc_status"))).drop("__hit")


def size_text(c: Column) -> Column:
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit("B"))).when(c < 1024 * 1024, F.concat(F.floor(c / 1024).cast("string"), F.lit("KB"))).otherwise(F.concat(F.floor(c / 1048576).cast("string"), F.lit("MB")))


def tagged(docs: DataFrame, tags: list[str]) -> DataFrame:
    """Documents that are not archived and have all the tags."""
    for t in tags:
        docs = docs.where(F.array_contains("tags", t))
    return docs.where("doc_status <> 'archived'")


def totals(docs: DataFrame) -> DataFrame:
    return docs.rollup("file_type", "doc_status").agg(F.count("*").alias("docs"), F.sum("vector_count").alias("vectors"), F.sum("file_size").alias("bytes"))


def numbered(docs: DataFrame) -> DataFrame:
    """Versions of a document with their place from the newest."""
    return docs.withColumn("age", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("doc_version"), "file_hash")))
