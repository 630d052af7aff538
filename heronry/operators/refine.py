"""Shortening found texts: line cleaning, extractive summaries, sentences that answer a query.

Everything stays in the row: arrays of lines or sentences and higher-order functions, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import EDGE, let

#: Words of a query end at white space and punctuation; sentences at a line's end or after a closing mark.
WORD_ENDS = r"[，。！？；：、\s,.!?;:\-]+"
SENTENCE = r"[^。！？.!?;；\n]+[。！？.!?;；]*"


#: Fixed value: a line that is a page number.
PAGE_LINE = r"(?i)^(?:第\s*[0-9]+\s*页|Page\s+[0-9]+|-\s*[0-9]+\s*-)$"


def stripped(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.regexp_replace(x, EDGE, ""))


def rule_clean(text: Column) -> Column:
    """Lines without white space around them; of blank lines in a row the first stays; lines that are a page number go."""

    def keep(lines: Column) -> Column:
        firsts = F.filter(lines, lambda x, i: (x != "") | (i == 0) | (F.get(lines, i - 1) != ""))
        full = F.filter(firsts, lambda x: ~x.rlike(r"^[0-9]{1,4}$") & ~x.rlike(PAGE_LINE))
        return F.array_join(F.transform(full, lambda x: F.regexp_replace(x, r"\s{2,}", " ")), "\n")

    return let(stripped(F.split(text, "\n")), keep)


def summary(text: Column, part: int = 100, short: int = 300, least: int = 20) -> Column:
    """First sentence, longest one between (if longer than ``least``), last one, each cut at ``part`` characters; a
    text of three sentences at most is cut at ``short``."""

    def take(s: Column) -> Column:
        middle = F.slice(s, 2, F.size(s) - 2)
        longest = F.array_max(F.transform(middle, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("x"))))
        parts = F.array(F.substring(s[0], 1, part), F.when(longest["n"] > least, F.substring(longest["x"], 1, part)), F.substring(F.element_at(s, -1), 1, part))
        return F.when(F.size(s) > 3, F.concat(F.array_join(F.array_compact(parts), "。"), F.lit("。")))

    sentences = F.filter(stripped(F.split(F.replace(text, F.lit("\n"), F.lit("。")), "。")), lambda x: x != "")
    return F.coalesce(let(sentences, lambda s: F.when(F.size(s) > 3, take(s))), F.substring(text, 1, short))


def answering(rows: DataFrame, query: str, text: str) -> DataFrame:
    """rows with ``refined``: the sentences that hold a word of the query, the first three if none does, in their order;
    ``n_hits`` counts the former."""
    words = F.array_distinct(F.filter(F.split(F.coalesce(query, F.lit("")), WORD_ENDS), lambda w: F.length(w) >= 2))
    sentences = F.filter(stripped(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), 0)), lambda x: x != "")
    rows = rows.withColumns({"__w": words, "__s": sentences})
    hits = F.filter("__s", lambda x: F.exists("__w", lambda w: F.contains(x, w)))
    rows = rows.withColumn("__h", hits)
    chosen = F.when(F.size("__h") > 0, F.col("__h")).otherwise(F.slice("__s", 1, 3))
    return rows.withColumns({"refined": F.array_join(chosen, "\n"), "n_hits": F.size("__h")}).drop("__w", "__s", "__h")
