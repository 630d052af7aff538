"""The whole way of a question: two arms over one corpus, parents without doubles, contexts with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.operators.retrieval import dense_search, fuse, sparse_search

#: Dimensions of hashed vectors.
DIMENSIONS = 64
#: Characters of a parent's sign, of its start that must not come again, and least length for that.
SIGN, START, LEAST_START = 300, 150, 50
#: Characters of a context and of a quoted hit, hits that are quoted, least score.
CONTEXT_CHARS, QUOTE_CHARS, QUOTES, LEAST_SCORE = 4000, 800, 8, 0.3
NO_ANSWER = "知识库中暂无相关信息"


def hashed_vectors(weights: DataFrame, id_col: str = "id") -> DataFrame:
    """id, v: sparse weights (id, token, weight) as dense vectors: each token adds to one dimension, with a sign, both from its hash."""
    code = F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("int")
    sign = F.when(code >= 32768, -1).otherwise(1)
    cells = weights.groupBy(F.col(id_col).alias("id"), F.pmod(code, F.lit(DIMENSIONS)).alias("dim")).agg(F.sum(F.col("weight") * sign).alias("x"))
    at = F.map_from_entries(F.collect_list(F.struct("dim", "x")))
    return cells.groupBy("id").agg(F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(at[i], F.lit(0.0))).alias("v"))


def hybrid_search(q: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k best by rank fusion of a sparse and a dense arm over the same texts, each with 2k
    candidates.  ``q`` (query_id, token, weight) and ``w`` (id, token, weight) are filtered before: what may not be found is
    not in ``w``.  A question without a known token is in neither."""
    ids = q.select("query_id").distinct().withColumn("qid", F.xxhash64("query_id"))
    vectors = hashed_vectors(q, "query_id").join(ids, F.col("id") == F.col("query_id")).select(F.col("qid").alias("id"), "v")
    dense = dense_search(vectors, hashed_vectors(w), "id", "v", 2 * k).withColumnRenamed("query_id", "qid").join(ids, "qid").drop("qid")
    return fuse(sparse_search(q, w, 2 * k), dense, k)


def sign(content: Column) -> Column:
    return F.substring(F.regexp_replace(content, r"[\s\p{Z}]+", ""), 1, SIGN)


def without_doubles(parents: DataFrame) -> DataFrame:
    """query_id, parent_id, place: parents (query_id, parent_id, content, best, total, n) of a question without those that say what a better one
    says: the same sign, or the start of one within the sign of the other.

    The better one has the higher best score, then the higher sum and number of hits (best * 100 + total + n), then the smaller id.
    A fold over the parents of one question, as many as it has hits; empty parents go."""
    # a parent that comes with several contents is taken with the first of them
    once = parents.groupBy("query_id", "parent_id").agg(F.min("content").alias("content"), F.max(F.round(F.col("best") * 100 + F.col("total") + F.col("n"), 6)).alias("priority"))
    entry = F.struct((-F.col("priority")).alias("p"), "parent_id", sign(F.col("content")).alias("sign"))
    rows = once.groupBy("query_id").agg(F.filter(F.array_sort(F.collect_list(entry)), lambda x: F.coalesce(x["sign"], F.lit("")) != "").alias("all"))
    inside = lambda a, b: (F.length(a) >= LEAST_START) & F.contains(b, F.substring(a, 1, START))

    def add(kept: Column, x: Column) -> Column:
        double = F.exists(kept, lambda y: (y["sign"] == x["sign"]) | inside(x["sign"], y["sign"]) | inside(y["sign"], x["sign"]))
        return F.when(double, kept).otherwise(F.concat(kept, F.array(F.struct(x["parent_id"].alias("parent_id"), x["sign"].alias("sign")))))

    kept = F.aggregate("all", F.array().cast("array<struct<parent_id:string,sign:string>>"), add)
    return rows.select("query_id", F.posexplode(kept).alias("place", "x")).select("query_id", "x.parent_id", (F.col("place") + 1).alias("place"))


def contexts(parents: DataFrame) -> DataFrame:
    """query_id, n_sources, context: the parents of a question (place, title, content) as numbered sources, each cut at CONTEXT_CHARS."""
    text = F.when(F.length("content") > CONTEXT_CHARS, F.concat(F.substring("content", 1, CONTEXT_CHARS), F.lit("\n...(内容过长，已截断)"))).otherwise(F.col("content"))
    head = F.concat(F.lit("[来源 "), F.col("place").cast("string"), F.lit("]"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" 章节: "), F.col("title"))).otherwise(""))
    rows = parents.withColumn("part", F.concat(head, F.lit("\n"), text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n\n")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_sources"), joined.alias("context"))


def quoted(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_quotes, answer: the best hits (rank, score, content) above LEAST_SCORE as quotes, or a note that there are none;
    every question has a row."""
    good = hits.where((F.col("rank") <= QUOTES) & (F.col("score") >= LEAST_SCORE))
    quote = F.concat(F.lit("[文档"), F.col("rank").cast("string"), F.lit("]\n"), F.substring("content", 1, QUOTE_CHARS))
    per = good.withColumn("quote", quote).groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))), lambda x: x["quote"]), "\n\n---\n\n").alias("text"))
    return queries.select("query_id").distinct().join(per, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_quotes"), F.coalesce("text", F.lit(NO_ANSWER)).alias("answer"))


def keywords(hits: DataFrame, first: int = 3, most: int = 10) -> DataFrame:
    """query_id, word, n: the most frequent words (2 to 15 characters between punctuation) of the first hits of each question."""
    words = F.filter(F.split("content", r"[，。！？；：、\s,.!?;:\-]+"), lambda w: (F.length(w) >= 2) & (F.length(w) <= 15))
    counts = hits.where(F.col("rank") <= first).select("query_id", F.explode(words).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "word")
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
