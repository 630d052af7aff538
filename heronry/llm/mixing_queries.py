"""Queries of problem 7: mixtures of the documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from heronry.llm.mixing import count_tokens, mix, shares
from heronry.tables import staged, table

TOKENIZER = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return staged(count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), TOKENIZER).drop("text"), "tokens")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_docs(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = _docs(spark, d), table(spark, d, "mix_targets")
    return shares(mix(docs, targets), docs, targets)


QUERIES = {"p7_mix": (p7_mix, None), "p7_shares": (p7_shares, None)}
