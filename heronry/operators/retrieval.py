"""Sparse and dense search for whole batches of queries, fusion, and what is made of the hits.

Queries are a table, so every step is one set-wise job; nothing loops over single queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.functions.text import tokens

#: Saturation of term counts, entries kept of a text, constant of rank fusion.
SATURATION, MOST_TERMS, RRF_C = 1.5, 128, 60
#: Share of all texts beyond which a token is a hot key.
HOT_SHARE = 0.02
#: Query vectors and corpus vectors that meet in one task.
BLOCK, PART = 4096, 50_000


def term_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, token, tf: the share of a text's tokens; null and empty texts have none.

    The texts are spread by their id; that partitioning also serves the count, so nothing else is shuffled."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(n, "id").select("id", tokens(F.col("text")).alias("all")).where("size(all) > 0")
    return each.select("id", F.size("all").alias("length"), F.explode("all").alias("token")).groupBy("id", "token", "length").agg(F.count("*").alias("n")).select("id", "token", (F.col("n") / F.col("length")).alias("tf"))


def document_frequency(terms: DataFrame) -> DataFrame:
    """token, df: in how many texts a token stands; partial counts before the shuffle, so a token of every text is no hot key."""
    return terms.groupBy("token").agg(F.count("*").alias("df"))


def inverse_frequency(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def with_frequency(terms: DataFrame, df: DataFrame, n: Column, share: float = HOT_SHARE) -> DataFrame:
    """terms with df.  Tokens of more than ``share`` of all texts are hot keys: there are at most (tokens of a text) / share of
    them, so they are broadcast; the others are joined by shuffle, without the rows of the hot ones."""
    hot = df.where(F.col("df") > n * share)
    marked = terms.join(F.broadcast(hot.withColumnRenamed("df", "hot")), "token", "left")
    rest = marked.where("hot is null").drop("hot").join(df.where(F.col("df") <= n * share), "token")
    return marked.where("hot is not null").withColumnRenamed("hot", "df").unionByName(rest)


def weights(terms: DataFrame, df: DataFrame, n: Column, most: int = MOST_TERMS) -> DataFrame:
    """id, token, weight: saturated share times inverse document frequency, the ``most`` heaviest of each text."""
    w = F.col("tf") * (SATURATION + 1) / (F.col("tf") + SATURATION) * inverse_frequency(F.col("df"), n)
    heavy = with_frequency(terms, df, n).select("id", "token", F.round(w, 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "token"))
    return heavy.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def query_weights(queries: DataFrame, id_col: str, text_col: str, df: DataFrame, n: Column) -> DataFrame:
    """query_id, token, weight: each known token of a query once, with its inverse document frequency."""
    each = queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    return each.join(df, "token").select("query_id", "token", F.round(inverse_frequency(F.col("df"), n), 9).alias("weight"))


def top(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query with their rank from 1; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def sparse_search(q: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the sum over shared tokens, an equi-join on the token with partial sums."""
    hits = q.withColumnRenamed("weight", "qw").join(w, "token").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
    return top(hits, k)


def dense_search(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, id, score, rank: exact nearest vectors.

    Queries are dealt into blocks and the corpus into parts; each block meets each part in one task, which multiplies
    the two and keeps the k best of each query.  What is shuffled besides is the corpus once for each block of
    queries.  Null vectors, and zero vectors with the cosine, are never found.
    """
    one = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    q, rows = one(queries), one(corpus)
    n_blocks = max(1, -(-q.count() // BLOCK))
    n = rows.count()
    n_parts = max(1, -(-n // PART), min(queries.sparkSession.sparkContext.defaultParallelism, -(-n // 500)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("block", deal(n_blocks)).withColumn("part", every(n_parts))
    right = rows.withColumn("part", deal(n_parts)).withColumn("block", every(n_blocks))
    right = right.toDF(*right.columns)  # columns of their own, also where one table is both sides
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_nearest(k, metric), "query_id long, id long, score double")
    return top(found, k)


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return m
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def _nearest(k: int, metric: str):
    def run(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(corpus):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        own, ids = corpus["id"].to_numpy(), queries["id"].to_numpy()
        m = _unit(np.array(corpus["v"].tolist(), np.float64), metric)
        out = []
        for a in range(0, len(ids), 256):  # a slice of queries bounds the matrix of scores
            s = np.round(_unit(np.array(queries["v"].iloc[a : a + 256].tolist(), np.float64), metric) @ m.T, 6)
            s[np.isnan(s)] = -np.inf
            # all that tie with the k-th stay: the window decides between them
            cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            at = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
            out.append(pd.DataFrame({"query_id": ids[a + at[0]], "id": own[at[1]], "score": s[at]}))
        return pd.concat(out)

    return run


def fuse(a: DataFrame, b: DataFrame, k: int, c: int = RRF_C) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a text in one list only has that list's share."""
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"], "full_outer")
    return top(both.select("query_id", "id", F.round(part("ra") + part("rb"), 9).alias("score")), k)


def keep_good(hits: DataFrame, least: float = 0.35, relative: float = 0.0, min_keep: int = 1) -> DataFrame:
    """Hits above the threshold (and above a share of the best one); if too few are left, the first ``min_keep``."""
    q = Window.partitionBy("query_id")
    good = (F.col("score") >= least) & (F.lit(relative <= 0) | (F.col("score") >= relative * F.max("score").over(q)))
    hits = hits.withColumn("good", good).withColumn("n_good", F.sum(F.col("good").cast("int")).over(q))
    return hits.where((F.col("good") & (F.col("n_good") >= min_keep)) | ((F.col("n_good") < min_keep) & (F.col("rank") <= min_keep))).drop("good", "n_good")


def parents_of(hits: DataFrame, children: DataFrame) -> DataFrame:
    """Parents of the hits (id = child) with the best score of their children and how many there were."""
    link = children.select(F.col("child_id").alias("id"), "parent_id").where("parent_id is not null and trim(parent_id) <> ''").distinct()
    return hits.join(link, "id").groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.count("*").alias("n_hits"))


def within_budget(parts: DataFrame, each: int, total: int, text: str = "text") -> DataFrame:
    """Contexts of a query in order of rank, each cut at ``each`` characters, until ``total`` is reached: the text
    that passes the total still counts, later ones do not."""
    cut = F.when(F.length(text) > each, F.concat(F.substring(F.col(text), 1, each), F.lit("..."))).otherwise(F.col(text))
    before = F.sum(F.length("context")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("context", cut).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < total).drop("before", text)


def same_start(parents: DataFrame, chars: int = 300) -> DataFrame:
    """parent_id, keep: of parents whose first characters without white space are equal only the first stays; empty ones go."""
    flat = F.substring(F.regexp_replace("content", r"[\s\p{Z}]+", ""), 1, chars)
    rows = parents.select("parent_id", "doc_id", flat.alias("sign")).where("sign <> ''").distinct()
    return rows.groupBy("sign").agg(F.min("parent_id").alias("parent_id"), F.count("*").alias("copies")).select("parent_id", "copies")


def title_prefixes(title: Column, sep: str = " · ") -> Column:
    """All proper prefixes of a path title, longest first: an equality key in place of a prefix comparison."""
    parts = F.split(title, sep)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), sep))).otherwise(F.array().cast("array<string>"))


def siblings(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents beside the found ones: same document and same title up to the last part, not found themselves."""
    p = parents.select("parent_id", "doc_id", "chapter_title").where("chapter_title is not null").distinct()
    prefix = p.withColumn("prefix", F.element_at(title_prefixes(F.col("chapter_title")), 1)).where("prefix is not null")
    start = hits.select("query_id", "parent_id").join(prefix, "parent_id").select("query_id", "doc_id", "prefix").distinct()
    near = start.join(prefix.select("parent_id", "doc_id", "prefix"), ["doc_id", "prefix"]).select("query_id", "parent_id", "prefix").distinct()
    return near.join(hits.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
