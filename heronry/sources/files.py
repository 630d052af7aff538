"""Reading document files and writing tables that can be replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators.lifecycle import upsert

TEXT_TYPES = ("txt", "md")
KNOWN_TYPES = (*TEXT_TYPES, "pdf", "docx", "xlsx", "xls", "png", "jpg", "jpeg")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder: path, file_name, ext, bytes, content_hash, doc_id, text and status.

    Text files are decoded as UTF-8; other known types have the status ``needs_parser`` and no text,
    unknown ones ``unsupported``.  One unreadable file does not stop the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    status = F.when(ext.isin(*TEXT_TYPES), "success").when(ext.isin(*KNOWN_TYPES), "needs_parser").otherwise("unsupported")
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), ext.alias("ext"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"),
        F.substring(F.md5(F.col("path").cast("binary")), 1, 12).alias("doc_id"),
        F.when(ext.isin(*TEXT_TYPES), F.decode("content", "UTF-8")).alias("text"), status.alias("status"),
    )


def save_markdown(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One folder of text files per document."""
    docs.where(f"{text_col} is not null").select(id_col, F.col(text_col).alias("value")).write.partitionBy(id_col).mode("overwrite").text(folder)


def replace_rows(spark: SparkSession, path: str, new: DataFrame, keys: list[str], target: str) -> None:
    """Write the table at ``path`` with the new rows in place of old ones with the same keys to ``target``: the old
    table stays readable until the caller switches over."""
    old = spark.read.parquet(path)
    upsert(old, new.select(*old.columns), keys).write.mode("overwrite").parquet(target)
