"""Text cleaning and tokenising as Column expressions: they stay inside the JVM and whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a page number, a running line, a link.
PAGE_NUMBER = r"^\s*(?:-?\s*\d{1,4}\s*-?|第\s*\d{1,4}\s*页|Page\s+\d{1,4}(?:\s+\d{1,4}\s*/\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4})\s*$"
RUNNING_LINE = r"^\s*(?:[©®™]\s*\d{4}.*|Copyright.*|Confidential.*|All Rights Reserved.*)\s*$"
LINK = r"https?://\S+|www\.\S+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
# Characters mapped one to one, and those that become several or none.
ONE_TO_ONE = ("‘’“”– ", "''\"\"- ")
ONE_TO_MANY = (("—", "--"), ("…", "..."), ("�", ""))
# Two-character words that carry no meaning for search.
STOP_WORDS = (
    "可以", "一个", "一些", "这样", "那样", "如何", "什么", "哪些", "哪里", "已经", "所以", "但是", "然而", "而且", "并且", "或者", "虽然", "尽管", "如果", "那么", "我们", "你们", "他们", "它们",
    "这个", "那个", "这些", "那些", "自己", "一下", "一种", "一定", "一起", "一直", "仍然", "依然", "还是", "其实", "因此", "然后", "后来", "以前", "以后", "现在", "刚刚", "通过", "进行", "实现",
    "完成", "开始", "结束", "提供", "使用", "采用", "包括", "以及", "相关", "相应", "需要", "要求", "可能", "应该", "必须", "关于", "对于", "按照", "根据", "由于", "基于", "针对", "随着", "没有",
    "公司", "工作", "业务", "发展", "情况", "问题", "方面", "部分",
)
EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression used inside a lambda would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, EDGE, "")


def fix_encoding(c: Column) -> Column:
    c = F.translate(c, *ONE_TO_ONE)
    for a, b in ONE_TO_MANY:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def squeeze(c: Column) -> Column:
    """One space for many, at most one blank line, no white space around lines; every kind of line end becomes a line feed."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"\r\n|[\r\x{2028}\x{2029}]", "\n")
    return F.regexp_replace(c, r"(?md)^[ \t\p{Z}]+|[ \t\p{Z}]+$", "")


def clean(c: Column, links: bool = False) -> Column:
    """Characters, page numbers, running lines and white space; null stays null, blank becomes empty."""
    c = F.regexp_replace(fix_encoding(c), CONTROL, "")
    c = F.regexp_replace(c, "(?mid)" + PAGE_NUMBER, "")
    c = F.regexp_replace(c, "(?mid)" + RUNNING_LINE, "")
    if links:
        c = F.regexp_replace(c, LINK, "")
    return strip(squeeze(c))


def clean_input(c: Column, limit: int = 1500) -> Column:
    """A user's message: stripped, cut at ``limit`` characters, in one line, without control characters."""
    c = strip(c)
    c = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, r"[\s\p{Z}]+", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def token_estimate(c: Column) -> Column:
    """Three tokens for two Chinese characters, one for four others, rounded down."""
    han = F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.floor(han * 1.5 + (F.length(c) - han) * 0.25).cast("int")


def normal_form(c: Column) -> Column:
    """Lower case, punctuation as single spaces; used to compare answers with texts."""
    c = F.regexp_replace(F.lower(c), r"[\s\x{3000}\x{2000}-\x{206f},，.。!！?？;；:：\"'「」『』()（）\[\]【】<>《》/\\\-—_=+*&^%$#@!~`]+", " ")
    return F.trim(c)


def tokens(c: Column) -> Column:
    """Words of Latin letters and digits with a letter (case kept, two characters at least) and pairs of
    neighbouring Chinese characters, without stop words; repeated ones stay."""
    words = F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+"), 0), lambda w: (F.length(w) >= 2) & w.rlike("[A-Za-z]"))
    runs = F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.concat(words, F.filter(pairs, lambda p: ~p.isin(*STOP_WORDS)))


def key_phrases(c: Column) -> Column:
    """Numbers, and all stretches of two to four letters, digits and Chinese characters of the normal form."""

    def phrases(norm: Column, flat: Column) -> Column:
        def grams(n: int) -> Column:
            cut = F.transform(F.sequence(F.lit(1), F.length(flat) - (n - 1)), lambda i: F.substring(flat, i, n))
            return F.when(F.length(flat) >= n, cut).otherwise(F.array().cast("array<string>"))

        numbers = F.regexp_extract_all(norm, F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), 0)
        return F.array_distinct(F.concat(numbers, grams(2), grams(3), grams(4)))

    return let(normal_form(c), lambda norm: let(F.regexp_replace(norm, r"[^\x{4e00}-\x{9fff}0-9a-z]", ""), lambda flat: phrases(norm, flat)))
