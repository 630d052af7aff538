"""Operators over the messages of a session: repeats, memory, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.functions.text import strip


#: Seconds of the slots of time that a session is cut into, so that a hot session is many groups.
SLOT_S = 86_400


def _slotted(rows: DataFrame) -> DataFrame:
    """Rows with the slot of their time; rows without a time come first, as in the order of time."""
    return rows.withColumn("slot", F.coalesce(F.floor(F.col("sent_at").cast("double") / SLOT_S).cast("long"), F.lit(-(1 << 62))))


def repeats(messages: DataFrame, times: int = 3) -> DataFrame:
    """message_id, session_id, is_spam: whether a message says the same as the ``times`` - 1 before it in the session;
    sessions are ordered by time and id.

    A look-back within each slot of time; the first messages of a slot look into the ends of the slots before, of
    which only the last ``times`` - 1 messages travel.  Blank messages and such without a session do not count."""
    said = F.md5(strip(F.col("message")))
    rows = messages.where("session_id is not null and session_id <> '' and message is not null and trim(message) <> ''").select("message_id", "session_id", "sent_at", said.alias("said")).distinct()
    rows = _slotted(rows)
    slot = Window.partitionBy("session_id", "slot")
    order = slot.orderBy("sent_at", "message_id")
    rows = rows.withColumns({"place": F.row_number().over(order), "back": F.row_number().over(slot.orderBy(F.desc("sent_at"), F.desc("message_id")))})
    rows = rows.withColumns({f"lag{k}": F.lag("said", k).over(order) for k in range(1, times)})
    ends = rows.where(F.col("back") < times).groupBy("session_id", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("back"), "said"))), lambda x: x["said"]).alias("tail"))
    # each slot has a message at least, so times - 1 slots hold as many messages
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy("session_id").orderBy("slot").rowsBetween(-(times - 1), -1)))
    wide = rows.join(ends.select("session_id", "slot", before.alias("before")), ["session_id", "slot"])
    spam = F.lit(True)
    for k in range(1, times):
        missing = F.size("before") - (k - F.col("place"))
        other = F.when(F.col("place") > k, F.col(f"lag{k}")).when(missing > 0, F.get("before", missing - 1))
        spam = spam & F.coalesce(other == F.col("said"), F.lit(False))
    return wide.select("message_id", "session_id", spam.alias("is_spam"))


def memory(messages: DataFrame, last: int = 6) -> DataFrame:
    """The last messages of each session, numbered from the newest.  The filter on the rank is a partial top-k before the shuffle."""
    order = Window.partitionBy("session_id").orderBy(F.desc("sent_at"), F.desc("message_id"))
    return messages.where("session_id is not null").distinct().withColumn("back", F.row_number().over(order)).where(F.col("back") <= last)


def compressed(messages: DataFrame, chars: float = 16000, most: int = 10, head: int = 2, tail: int = 8) -> DataFrame:
    """Of sessions with more than ``chars`` characters and ``most`` messages the first and last ones; other sessions stay whole.

    Places are counted within slots of time, to which the sums of the slots before are added."""
    rows = _slotted(messages.where("session_id is not null").distinct())
    slots = rows.groupBy("session_id", "slot").agg(F.count("*").alias("m"), F.sum(F.coalesce(F.length("message"), F.lit(0))).alias("c"))
    s = Window.partitionBy("session_id")
    upto = F.coalesce(F.sum("m").over(s.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.select("session_id", "slot", upto.alias("before"), F.sum("m").over(s).alias("n"), F.sum("c").over(s).alias("chars"))
    order = Window.partitionBy("session_id", "slot").orderBy("sent_at", "message_id")
    rows = rows.withColumn("place", F.row_number().over(order)).join(slots, ["session_id", "slot"]).withColumn("place", (F.col("place") + F.col("before")).cast("int"))
    rows = rows.where((F.col("chars") <= chars) | (F.col("n") <= most) | (F.col("place") <= head) | (F.col("place") > F.col("n") - tail))
    return rows.drop("slot", "before")


def clocks(events: DataFrame, node: str, counter: str, owner: str) -> DataFrame:
    """owner, node, ticks: vector clocks in long form, from counted events."""
    return events.groupBy(F.col(owner).alias("owner"), F.col(node).alias("node")).agg(F.count(counter).alias("ticks"))


def merge_clocks(clock: DataFrame) -> DataFrame:
    """The pointwise greatest of all clocks: node, ticks."""
    return clock.groupBy("node").agg(F.max("ticks").alias("ticks"))


def relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, relation of two clocks per key (key, node, ticks): equal, a_after_b, b_after_a or concurrent; a missing entry is 0."""
    x = a.select("key", "node", F.col("ticks").alias("x")).join(b.select("key", "node", F.col("ticks").alias("y")), ["key", "node"], "full_outer").fillna(0, ["x", "y"])
    per = x.groupBy("key").agg(F.max(F.col("x") > F.col("y")).alias("more"), F.max(F.col("x") < F.col("y")).alias("less"))
    return per.select("key", F.when(F.col("more") & F.col("less"), "concurrent").when(F.col("more"), "a_after_b").when(F.col("less"), "b_after_a").otherwise("equal").alias("relation"))


def order_numbers(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, number, place: up to five distinct order numbers of a text, dated ones first, then codes that are not plain long numbers."""
    words = F.split(F.regexp_replace(F.col(text_col), r"[^\p{L}\p{N}_]+", " "), " ")
    dated = F.filter(words, lambda w: w.rlike("^20[0-9]{6,20}$"))
    codes = F.filter(F.transform(words, F.upper), lambda w: w.rlike("^[A-Z0-9]{8,30}$") & ~w.rlike("^[0-9]{11,}$"))
    found = F.slice(F.array_distinct(F.concat(dated, codes)), 1, 5)
    return messages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("place", "number"))
