"""Rule-based quality of answers: which phrases of one text stand in another.

All texts of a case are columns of one row, so a case is scored without any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import key_phrases, let, normal_form

METRICS = ("faithfulness", "context_precision", "contextualrecall", "answer_relevancy")


def coverage(phrases: Column, text: Column) -> Column:
    """Share of the phrases that the normalised text holds; 0.5 where there are no phrases or no text."""

    def share(p: Column, t: Column) -> Column:
        hit = F.size(F.filter(p, lambda x: F.contains(t, x)))
        return F.when((F.size(p) > 0) & (F.coalesce(t, F.lit("")) != ""), F.round(hit / F.size(p), 4)).otherwise(0.5)

    return let(F.struct(phrases.alias("p"), text.alias("t")), lambda x: share(x["p"], x["t"]))


def rule_metrics(cases: DataFrame) -> DataFrame:
    """cases (question, contexts, answer, reference) with METRICS, and ``score``, their mean.

    The phrases and normal forms are columns of their own first, so that each is made once."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = cases.withColumns({"__ctx": normal_form(blank("contexts")), "__ans": normal_form(blank("answer"))})
    rows = rows.withColumns({"__q": key_phrases(blank("question")), "__a": key_phrases(blank("answer")), "__r": key_phrases(blank("reference"))})
    rows = rows.withColumns({
        "faithfulness": coverage(F.col("__a"), F.col("__ctx")),
        "context_precision": coverage(F.col("__q"), F.col("__ctx")),
        "contextualrecall": coverage(F.col("__r"), F.col("__ans")),
        "answer_relevancy": coverage(F.col("__q"), F.col("__ans")),
    })
    total = sum((F.col(m) for m in METRICS[1:]), F.col(METRICS[0]))
    return rows.withColumn("score", F.round(total / len(METRICS), 6)).drop("__ctx", "__ans", "__q", "__a", "__r")


def keyword_hits(cases: DataFrame) -> DataFrame:
    """How many of the expected keywords the answer has, and whether a forbidden one stands in it."""
    has = lambda words: F.size(F.filter(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda w: F.contains(F.coalesce("answer", F.lit("")), w)))
    return cases.withColumns({"expected_hits": has("expected_keywords"), "forbidden_hits": has("forbidden_keywords")})


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").when(score > 0, "poor").otherwise("none")


def summary(scored: DataFrame, by: str = "category") -> DataFrame:
    """Means of the metrics per category and over all (category null) in one pass."""
    return scored.rollup(by).agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 4).alias(m) for m in (*METRICS, "score")])
