"""Queries over chat sessions and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import sessions as ss
from heronry.plans.text_queries import SQL_STRIP
from heronry.tables import table


def _chat(spark, d):
    return table(spark, d, "chat_messages")


def q_spam(spark, d):
    return ss.repeats(_chat(spark, d))


def q_memory_window(spark, d):
    last = ss.memory(_chat(spark, d))
    return last.groupBy("session_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("back"), F.coalesce("message", F.lit("")).alias("m")))), lambda x: x["m"]), "\n")).alias("memory_md5"), F.count("*").alias("n"))


def q_memory_compressed(spark, d):
    return ss.compressed(_chat(spark, d), 400).select("message_id", "session_id", "place", "n")


def _clock(spark, d, status: str):
    rows = table(spark, d, "requests").distinct().where(F.col("status") == status).where("session_id is not null and agent is not null")
    return ss.clocks(rows, "agent", "request_id", "session_id").withColumnRenamed("owner", "key")


def q_clock_merge(spark, d):
    rows = table(spark, d, "requests").distinct().where("session_id is not null and agent is not null")
    return ss.merge_clocks(ss.clocks(rows, "agent", "request_id", "session_id"))


def q_clock_relation(spark, d):
    """Per session the clock of its good calls against that of its failed ones."""
    return ss.relation(_clock(spark, d, "success"), _clock(spark, d, "error"))


def q_order_numbers(spark, d):
    return ss.order_numbers(_chat(spark, d).select("message_id", "message").distinct(), "message_id", "message")


_CHAT = "m AS (SELECT DISTINCT * FROM chat_messages WHERE session_id IS NOT NULL)"

QUERIES = {
    "q_spam": (
        q_spam,
        f"WITH m AS (SELECT DISTINCT *, md5({SQL_STRIP.format(c='message')}) AS s FROM chat_messages WHERE session_id <> '' AND trim(message) <> '') SELECT message_id, session_id, coalesce(lag(s) OVER w = s, false) AND coalesce(lag(s, 2) OVER w = s, false) AS is_spam FROM m WINDOW w AS (PARTITION BY session_id ORDER BY sent_at, message_id)",
    ),
    "q_memory_window": (
        q_memory_window,
        f"WITH {_CHAT}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sent_at DESC, message_id DESC) AS back FROM m QUALIFY back <= 6) SELECT session_id, md5(string_agg(coalesce(message, ''), chr(10) ORDER BY back DESC)) AS memory_md5, count(*) AS n FROM b GROUP BY 1",
    ),
    "q_memory_compressed": (
        q_memory_compressed,
        f"WITH {_CHAT}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sent_at, message_id) AS place, count(*) OVER (PARTITION BY session_id) AS n, sum(coalesce(length(message), 0)) OVER (PARTITION BY session_id) AS chars FROM m) SELECT message_id, session_id, place, n FROM b WHERE chars <= 400 OR n <= 10 OR place <= 2 OR place > n - 8",
    ),
    "q_clock_merge": (
        q_clock_merge,
        "SELECT node, max(t) AS ticks FROM (SELECT session_id, agent AS node, count(request_id) AS t FROM (SELECT DISTINCT * FROM requests) WHERE session_id IS NOT NULL AND agent IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    ),
    "q_clock_relation": (
        q_clock_relation,
        "WITH c AS (SELECT session_id AS key, agent AS node, status, count(request_id) AS t FROM (SELECT DISTINCT * FROM requests) WHERE session_id IS NOT NULL AND agent IS NOT NULL AND status IN ('success', 'error') GROUP BY 1, 2, 3), p AS (SELECT key, node, coalesce(max(t) FILTER (status = 'success'), 0) AS x, coalesce(max(t) FILTER (status = 'error'), 0) AS y FROM c GROUP BY 1, 2), q AS (SELECT key, bool_or(x > y) AS more, bool_or(x < y) AS less FROM p GROUP BY 1) SELECT key, CASE WHEN more AND less THEN 'concurrent' WHEN more THEN 'a_after_b' WHEN less THEN 'b_after_a' ELSE 'equal' END AS relation FROM q",
    ),
    "q_order_numbers": (
        q_order_numbers,
        "WITH k AS (SELECT message_id AS id, string_split(regexp_replace(message, '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') AS w FROM (SELECT DISTINCT message_id, message FROM chat_messages)), x AS (SELECT id, list_filter(w, lambda c: regexp_matches(c, '^20[0-9]{6,20}$')) || list_filter(list_transform(w, lambda c: upper(c)), lambda c: regexp_matches(c, '^[A-Z0-9]{8,30}$') AND NOT regexp_matches(c, '^[0-9]{11,}$')) AS a FROM k), u AS (SELECT id, unnest(a) AS number, generate_subscripts(a, 1) AS k FROM x), f AS (SELECT id, number, min(k) AS k FROM u GROUP BY 1, 2) SELECT id, number, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS place FROM f QUALIFY place < 5",
    ),
}
