"""What is made of chapters: demoted headings, documents pasted twice, topics, tables of contents, packed lists.

Rows are lines, paragraphs or sections with their place; what depends on order is a window or a fold over
the ordered entries of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.functions.text import strip
from heronry.operators.structure import heading_level, lines

# The topics of paragraphs in their order, with the words that tell them.
TOPICS = (
    ("商品与产品", ("商品", "产品", "目录", "分类", "编号", "售价", "简介", "规格")),
    ("服务与支持", ("客服", "服务", "售后", "支持", "电话", "邮箱", "在线")),
    ("政策与流程", ("政策", "流程", "规定", "退换", "保修", "退货", "退款")),
    ("会员与积分", ("会员", "积分", "等级", "特权", "权益")),
    ("支付与配送", ("支付", "配送", "物流", "运费", "发货")),
    ("平台简介", ("平台", "简介", "概述", "公司", "承诺", "理念")),
)
OTHER_TOPIC = "其他内容"
#: Children that a chapter needs for a table of contents, characters of a first line in it.
LEAST_CHILDREN, FIRST_LINE = 3, 150
#: Items and characters of a list chunk, and length beyond which an item stands alone.
ITEMS, LIST_CHARS, LONG_ITEM = 4, 800, 500


def demoted(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, line_no, line, demoted: Markdown headings; the first of level one stays, later ones and numbered ones of
    level two go to level three."""
    rows = lines(docs, ids, text).withColumn("hashes", F.length(F.regexp_extract("line", r"^(#{1,6})\s+.+", 1))).where("hashes > 0")
    nth = F.sum((F.col("hashes") == 1).cast("int")).over(Window.partitionBy(*ids).orderBy("line_no"))
    rows = rows.withColumn("nth", nth)
    down = ((F.col("hashes") == 1) & (F.col("nth") > 1)) | ((F.col("hashes") == 2) & F.col("line").rlike(r"^##\s+[0-9一二三四五六七八九十]+(?:\.[0-9]+)*[.、\s]"))
    title = F.regexp_replace("line", r"^#{1,6}\s+", "")
    return rows.select(*ids, "line_no", "line", F.when(down, F.concat(F.lit("### "), title)).otherwise(F.col("line")).alias("demoted"))


def numeral(text: Column) -> Column:
    """The number that digits or Chinese numerals (up to thousands) say; what says none is 100."""
    digits = "零一二三四五六七八九"
    state = lambda total, now: F.struct(total.cast("int").alias("total"), now.cast("int").alias("now"))

    def add(acc: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000)
        digit = F.when(ch == "两", 2).otherwise(F.instr(F.lit(digits), ch) - 1)
        return F.when(unit.isNotNull(), state(acc["total"] + F.greatest(acc["now"], F.lit(1)) * unit, F.lit(0))).otherwise(state(acc["total"], digit))

    whole = F.aggregate(F.split(text, ""), state(F.lit(0), F.lit(0)), add, lambda acc: acc["total"] + acc["now"])
    return F.when(text.rlike("^[0-9]+$"), text.cast("int")).when(whole > 0, whole).otherwise(100)


def pasted_twice(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, top, cut_line: documents of three chapters at least whose numbering starts again behind the highest number: the first later
    chapter with at most half of it (or 3) begins a copy, and the text from that line on goes."""
    rows = lines(docs, ids, text)
    title = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), strip(F.regexp_replace("line", r"^#{1,6}\s+", ""))).when(F.length("line") < 80, F.col("line"))
    rows = rows.withColumn("title", title).where(F.col("title").rlike(r"^第[一二三四五六七八九十百千0-9]+章"))
    rows = rows.withColumn("number", numeral(F.regexp_extract("title", r"([一二三四五六七八九十百千0-9]+)", 1)))
    doc = Window.partitionBy(*ids)
    rows = rows.withColumns({"n": F.count("*").over(doc), "top": F.max("number").over(doc)})
    rows = rows.withColumn("peak", F.min(F.when(F.col("number") == F.col("top"), F.col("line_no"))).over(doc))
    again = rows.where("n >= 3 and line_no > peak and number <= greatest(floor(top / 2), 3)")
    return again.groupBy(*ids).agg(F.max("top").alias("top"), F.min("line_no").alias("cut_line"))


def topics(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, topic, first, n, chars: paragraphs by the first topic whose word they hold, topics in the order of their first paragraph."""
    blocks = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n[\s\p{Z}]*\n")
    rows = docs.select(*ids, F.posexplode(F.transform(blocks, strip)).alias("place", "para")).where("para <> ''")
    topic = F.lit(None).cast("string")
    for name, words in reversed(TOPICS):
        topic = F.when(F.col("para").rlike("|".join(words)), name).otherwise(topic)
    rows = rows.withColumn("topic", F.coalesce(topic, F.lit(OTHER_TOPIC)))
    return rows.groupBy(*ids, "topic").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum(F.length("para")).alias("chars"))


def contents(found: DataFrame, ids: list[str]) -> DataFrame:
    """ids, section, n_children, contents: tables of contents of sections (section, level, title, path, content) with three children at least.

    The parent of a section is the one with the largest smaller level whose path begins its own: an equality
    join on every proper prefix of the path, as paths are made of whole titles."""
    parts = F.split("path", " · ")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), " · "))
    children = found.withColumn("above", F.explode(F.when(F.size(parts) > 1, up)))
    first = F.element_at(F.filter(F.transform(F.split("content", "\n"), strip), lambda x: x != ""), 1)
    short = F.when(F.length(first) > FIRST_LINE, F.concat(F.substring(first, 1, FIRST_LINE), F.lit("..."))).otherwise(first)
    # size 0 has no first element
    entry = F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.col("title")).otherwise(F.concat_ws(" - ", "title", short))
    children = children.select(*ids, F.col("section").alias("child"), F.col("level").alias("own"), entry.alias("entry"), "above")
    parents = found.select(*ids, "section", "level", F.col("path").alias("above"))
    pairs = children.join(parents, [*ids, "above"]).where("level < own and section <> child")
    near = Window.partitionBy(*ids, "child").orderBy(F.desc("level"), "section")
    best = pairs.withColumn("r", F.row_number().over(near)).where("r = 1")
    each = F.transform(F.array_sort(F.collect_list(F.struct("child", "entry"))), lambda x: x["entry"])
    out = best.groupBy(*ids, "section").agg(F.count("*").alias("n_children"), F.array_join(each, "\n").alias("entries")).where(f"n_children >= {LEAST_CHILDREN}")
    return out.select(*ids, "section", "n_children", F.concat(F.lit("【本章包含以下"), F.col("n_children").cast("string"), F.lit("个子章节】\n"), F.col("entries")).alias("contents"))


def list_chunks(docs: DataFrame, ids: list[str], text: str, kind: str = r"^[0-9]+[.、:：]\s*\S", size: int = LIST_CHARS) -> DataFrame:
    """ids, chunk, first, last, chars: numbered lists packed into chunks that never part an item.

    An item goes from its line to the next item or heading; a list needs three.  A chunk takes ITEMS items and ``size``
    characters; an item of more than LONG_ITEM characters that would open a chunk is one by itself."""
    rows = lines(docs, ids, text)
    order = Window.partitionBy(*ids).orderBy("line_no")
    is_item = F.col("line").rlike(kind)
    rows = rows.withColumn("item", F.sum(is_item.cast("int")).over(order)).where("item > 0")
    # a heading closes the item; what follows it until the next item is no part of the list
    shut = F.max((heading_level(F.col("line")).isNotNull() & ~is_item).cast("int")).over(Window.partitionBy(*ids, "item").orderBy("line_no"))
    items = rows.withColumn("shut", shut).where("shut = 0 and line <> ''").groupBy(*ids, "item").agg((F.sum(F.length("line")) + F.count("*") - 1).cast("int").alias("chars"))
    whole = items.groupBy(*ids).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("item", "chars"))).alias("items")).where("n >= 3")
    state = lambda out, first, last, n, chars: F.struct(out.alias("out"), first.alias("first"), last.alias("last"), n.alias("n"), chars.alias("chars"))
    chunk = lambda first, last, chars: F.array(F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"), chars.cast("int").alias("chars")))
    zero, none = F.lit(0), F.lit(0).cast("long")
    empty = F.array().cast("array<struct<first:bigint,last:bigint,chars:int>>")

    def add(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= ITEMS) | (acc["chars"] + x["chars"] > size))
        out = F.when(full, F.concat(acc["out"], chunk(acc["first"], acc["last"], acc["chars"]))).otherwise(acc["out"])
        alone = (acc["n"] == 0) & (x["chars"] > LONG_ITEM)
        fresh = full | (acc["n"] == 0)
        item = x["item"].cast("long")
        return F.when(alone, state(F.concat(acc["out"], chunk(item, item, x["chars"])), none, none, zero, zero)).otherwise(
            state(out, F.when(fresh, item).otherwise(acc["first"]), item, F.when(fresh, 1).otherwise(acc["n"] + 1), F.when(fresh, x["chars"]).otherwise(acc["chars"] + x["chars"]))
        )

    packed = F.aggregate("items", state(empty, none, none, zero, zero), add, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], chunk(acc["first"], acc["last"], acc["chars"]))).otherwise(acc["out"]))
    return whole.select(*ids, F.posexplode(packed).alias("chunk", "c")).select(*ids, "chunk", "c.first", "c.last", "c.chars")
