"""Loading the input tables and cutting lineage through the shared folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; TIMESTAMP_NTZ columns become TIMESTAMP (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, an own one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Staged:
    """A table written once to the shared folder, so that it survives the loss of executors.

    ``df`` reads it back; ``drop()`` removes the files when a later stage has replaced it; what is left goes
    when the driver ends.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        fs, at = _file(self.spark, self.path)
        fs.deleteOnExit(at)

    def drop(self) -> None:
        fs, path = _file(self.spark, self.path)
        fs.delete(path, True)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def staged(df: DataFrame, label: str) -> DataFrame:
    return Staged(df, label).df


def iso_time(c: Column) -> Column:
    """ISO 8601 text in any of the layouts in use; without an offset it means UTC, whatever the session's zone."""
    text = F.trim(c)
    zoned = text.rlike(r"[Zz]$|[+-]\d{2}:?\d{2}$") & text.rlike(r"\d{2}:\d{2}")
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(zoned, text).otherwise(F.concat(text, F.lit("Z")))
    return whole.try_cast("timestamp")


def ref_key(c: Column) -> Column:
    """Keys in references compare trimmed and without regard to case; blank means no reference."""
    key = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(key != "", key)


def input_state(df: DataFrame) -> str:
    """A sign of the files below a table: their names, sizes and times of change."""
    spark, seen = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        fs, at = _file(spark, name)
        status = fs.getFileStatus(at)
        seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.md5("\n".join(seen).encode()).hexdigest()


@lru_cache(maxsize=8)
def code_state(folder: str) -> str:
    """A sign of the code in a folder of this package, so that what older code has kept is not taken for new."""
    here = Path(__file__).parent / folder
    return hashlib.md5(b"".join(p.read_bytes() for p in sorted(here.glob("*.py")))).hexdigest()[:8]


def kept(source: DataFrame, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from ``source``, built once for a state of its files and kept in the shared folder, where later queries find it."""
    spark = source.sparkSession
    path = f"{shared_dir(spark)}/{label}-{code_state('operators')}-{code_state('functions')}-{input_state(source)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
