"""Mixing sources to target weights (problem 7): systematic sampling.

A recipe gives each source a share of the total size.  Every document of a source has the same
number of expected copies; the expected copies are summed up along the source, one random offset is
added, and a document is emitted once for each whole number that its stretch of the sum crosses.
The documents of a source are ordered by size, so that the sample has the sizes of its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.tables import staged

#: Expected copies are whole numbers of this fraction, so that sums are exact in any order.
UNIT = 10**9
#: Parts of each size class of a source, at least, and documents that a part has on average, at most; each part is summed by itself.
SPLITS, PART_DOCS = 64, 100_000


def source_name(c: Column) -> Column:
    """Spellings of a source fall together: case, white space, hyphens."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when(name != "", name)


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs with ``tokens``: the size of ``text`` in tokens of the public byte-level tokenizer whose rank
    file is ``tokenizer``.  Null and empty texts have no tokens."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer)
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn("tokens", F.pandas_udf(count, "long")("text"))


def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per recipe and source: available size and expected copies per document.

    Without ``total`` each recipe gets the largest total at which every source that has any text
    reaches its share within its max_repeats; with ``total``, sources that would need more
    repeats stay at their cap and below their share.  Shares of absent sources go to the others in
    proportion.  Rows of a recipe that name one source twice are added up, with the smaller cap.
    Targets without a source, a positive share or a positive cap are not asked for.
    """
    asked = (
        targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats > 0")
        .groupBy("mix_id", "source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    there = asked.join(sizes, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    recipe = Window.partitionBy("mix_id")
    reachable = F.col("available") * F.col("max_repeats")
    share = F.when(F.col("available") > 0, F.col("target_share"))
    scaled = F.when(F.col("available") > 0, F.col("target_share") / F.sum(share).over(recipe))
    there = there.withColumn("scaled", scaled)
    fits = F.min(F.when(F.col("available") > 0, reachable / F.col("scaled"))).over(recipe)
    there = there.withColumn("mix_total", F.lit(float(total)) if total else fits)
    expected = F.col("mix_total") * F.col("scaled") / F.col("available")
    return there.withColumn("copies", F.least(F.floor(expected * UNIT), F.col("max_repeats").cast("long") * UNIT)).drop("scaled")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None) -> DataFrame:
    """mix_id, source, doc_id, tokens, copies: the documents of every recipe with the copies to use.

    ``docs`` has doc_id, source and tokens.  Documents without tokens or source are left out; a
    document is used at most max_repeats times.  The running sum is built in two steps - over the
    sums of (size class, split) and within each of those - so that no source is summed in one task.
    """
    docs = docs.select(source_name(F.col("source")).alias("source"), "doc_id", "tokens").where("source is not null and tokens > 0")
    docs = docs.withColumn("size", F.floor(F.log2("tokens") * 8).cast("int"))
    docs = staged(docs, "sized")
    splits = max(SPLITS, -(-docs.count() // PART_DOCS))
    docs = docs.withColumn("split", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(splits)))
    cells = staged(docs.groupBy("source", "size", "split").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available")), "cells")
    sizes = cells.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("available").alias("available"))
    wanted = plan(sizes, targets, total).where("copies > 0").select("mix_id", "source", "copies")
    before = F.sum("docs").over(Window.partitionBy("source").orderBy("size", "split").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("source", "size", "split", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("source", "size", "split").orderBy("tokens", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    placed = docs.withColumn("nth", F.row_number().over(order) - 1).join(starts, ["source", "size", "split"])
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source"), F.lit(UNIT))
    first = (F.col("before") + F.col("nth")).cast("decimal(38,0)") * F.col("copies") + offset
    crossed = F.floor((first + F.col("copies")) / UNIT) - F.floor(first / UNIT)
    return placed.join(wanted, "source").select("mix_id", "source", "doc_id", "tokens", crossed.cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per recipe and source of the targets: wanted and actual share, documents, copies and tokens."""
    docs = docs.select(source_name(F.col("source")).alias("source"), "tokens").where("source is not null and tokens > 0")
    sizes = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    used = mixed.groupBy("mix_id", "source").agg(
        F.count("*").alias("docs_used"), F.sum("copies").alias("copies_used"), F.max("copies").alias("most_copies"),
        F.sum(F.col("copies") * F.col("tokens")).alias("tokens_used"),
    )
    out = plan(sizes, targets, total).select("mix_id", "source", "target_share", "max_repeats", "docs", "available").join(used, ["mix_id", "source"], "left")
    out = out.fillna(0, ["docs_used", "copies_used", "most_copies", "tokens_used"])
    whole = F.sum("tokens_used").over(Window.partitionBy("mix_id"))
    return out.withColumn("actual_share", F.when(whole > 0, F.round(F.col("tokens_used") / whole, 6)).otherwise(0.0))
