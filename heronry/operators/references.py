"""References to records that do not exist (problem 2).

Parent keys, deletions and child keys are put in one long form ``(target, key, tag, ...)``
and grouped by target table and key.  The group tells what is left of the target; only the
keys without a usable target go back to the referring rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.tables import iso_time, ref_key, staged

#: A key that holds at least 1/HOT_PARTS of the rows that go back is hot: there are at most HOT_PARTS of them.
HOT_PARTS = 64
SALTS = 32


@dataclass(frozen=True)
class Reference:
    """``rows.ref`` names ``targets.key``; ``rows.row_id`` identifies the referring row."""

    table_name: str
    rows: DataFrame
    row_id: str
    ref: str
    target_name: str
    targets: DataFrame
    key: str
    created: str = "created_at"


def _deletions(deletions: DataFrame) -> DataFrame:
    """The last deletion of each key; a key that is only named with unreadable times has none."""
    return (
        deletions.select(
            F.lower(F.trim("target_table")).alias("target"),
            ref_key(F.col("target_key")).alias("key"),
            iso_time(F.col("deleted_at")).alias("deleted"),
        )
        .where("target is not null and key is not null")
        .groupBy("target", "key")
        .agg(F.max("deleted").alias("last_deleted"))
    )


def _referring(refs: list[Reference]) -> DataFrame:
    out = None
    for r in refs:
        part = r.rows.select(
            F.lit(r.table_name).alias("table_name"),
            F.col(r.row_id).cast("string").alias("row_id"),
            F.lit(r.target_name).alias("target"),
            ref_key(F.col(r.ref)).alias("key"),
            iso_time(F.col(r.created)).alias("row_created"),
        )
        out = part if out is None else out.unionByName(part)
    return out.where("key is not null")


def key_states(refs: list[Reference], deletions: DataFrame) -> DataFrame:
    """One row per target table and key that is referred to or exists:
    n_refs, newest_ref, n_left, first_left, left_unknown, named_deleted.

    Targets created at or before the last deletion of their key count as gone; a target whose
    time is unknown cannot be shown to be older and stays.
    """
    gone = _deletions(deletions)
    parents = None
    for r in refs:
        part = r.targets.select(
            F.lit(r.target_name).alias("target"),
            ref_key(F.col(r.key)).alias("key"),
            iso_time(F.col(r.created)).alias("created"),
        )
        parents = part if parents is None else parents.unionByName(part)
    # copies and versions of a target collapse before anything is shuffled
    parents = parents.where("key is not null").distinct().join(gone, ["target", "key"], "left")
    left = parents.where("last_deleted is null or created is null or created > last_deleted")

    none = F.lit(None).cast("timestamp")
    zero = F.lit(0).cast("long")
    parent_side = left.select(
        "target", "key", F.lit(1).cast("long").alias("is_parent"), zero.alias("is_ref"), zero.alias("is_deleted"),
        "created", F.col("created").isNull().cast("int").alias("unknown"), none.alias("row_created"),
    )
    deletion_side = gone.select(
        "target", "key", zero.alias("is_parent"), zero.alias("is_ref"), F.lit(1).cast("long").alias("is_deleted"),
        none.alias("created"), F.lit(0).alias("unknown"), none.alias("row_created"),
    )
    child_side = _referring(refs).select(
        "target", "key", zero.alias("is_parent"), F.lit(1).cast("long").alias("is_ref"), zero.alias("is_deleted"),
        none.alias("created"), F.lit(0).alias("unknown"), "row_created",
    )
    return (
        parent_side.unionByName(deletion_side)
        .unionByName(child_side)
        .groupBy("target", "key")
        .agg(
            F.sum("is_ref").alias("n_refs"),
            F.min("row_created").alias("oldest_ref"),
            F.sum("is_parent").alias("n_left"),
            F.min("created").alias("first_left"),
            F.max("unknown").alias("left_unknown"),
            F.max("is_deleted").alias("named_deleted"),
        )
    )


def orphans(refs: list[Reference], deletions: DataFrame) -> DataFrame:
    """Every referring row without a usable target: table_name, row_id, key, row_created, reason.

    reason is ``missing`` (no target, never deleted), ``deleted`` (no target left, the log names
    the key) or ``late`` (all targets left were created after the referring row; unknown times
    are never late).  Null and blank references are no cases.  Copies of a row give one result.
    Empty tables give an empty result; extra columns are ignored.

    The hot keys are salted for the way back to the rows: a key with at least 1/HOT_PARTS of the
    suspects' references is hot, so that the broadcast list of hot keys has at most HOT_PARTS rows.
    """
    states = key_states(refs, deletions).where("n_refs > 0")
    suspects = states.where(
        "n_left = 0 or (left_unknown = 0 and oldest_ref < first_left)"
    ).select(
        "target", "key", "n_refs", "n_left", "first_left",
        F.when(F.col("n_left") > 0, "late").when(F.col("named_deleted") > 0, "deleted").otherwise("missing").alias("reason"),
    )
    suspects = staged(suspects, "suspects")  # three readers: the list of hot keys, their total and the way back
    total = suspects.agg(F.sum("n_refs").alias("total")).scalar()
    suspects = suspects.withColumn("hot", F.col("n_refs") * HOT_PARTS >= total)
    hot_keys = suspects.where("hot").select("target", "key", F.lit(SALTS).alias("salts"))
    rows = _referring(refs).join(F.broadcast(hot_keys), ["target", "key"], "left")
    rows = rows.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row_id"), F.col("salts"))).otherwise(0))
    spread = suspects.withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).withColumn("salt", F.col("salt").cast("long"))
    found = rows.withColumn("salt", F.col("salt").cast("long")).join(
        spread.select("target", "key", "salt", "first_left", "reason"), ["target", "key", "salt"]
    )
    found = found.where(F.expr("reason <> 'late' or row_created < first_left"))
    return found.select("table_name", "row_id", "target", "key", "row_created", "reason").distinct()


def orphan_counts(found: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """Orphans per referring table, period of created_at and reason; rows without a time are in period 'unknown'."""
    return found.groupBy(
        "table_name", F.coalesce(F.date_format("row_created", period), F.lit("unknown")).alias("period"), "reason"
    ).agg(F.count("*").alias("n_orphans"), F.countDistinct("key").alias("n_keys"))


