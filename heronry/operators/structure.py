"""Structure of documents: headings, sections, lists, chunks, windows of chunks.

Lines are exploded with their place; sections are running sums over them; sentences are packed into
chunks by a fold over the ordered sentences of a section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.functions.text import strip

#: Children of a parent window and the step between windows; size of a child; shortest tail of a paragraph; shortest sentence.
WINDOW, STRIDE, CHILD_CHARS, LEAST_TAIL, LEAST_SENTENCE = 6, 3, 800, 100, 20
#: Titles that are no headings.
NOISE_TITLES = ("文档标题", "document title", "目录", "contents", "content", "章节标题")
NO_HEADING = "正文"
#: Words that tell a line about a product.
PRODUCT_WORDS = ("商品", "产品", "售价", "价格", "规格", "品牌", "编号", "型号")
#: Fixed value: titles of groups of chapters.
GROUP_TITLE = r"^第[一二三四五六七八九十百0-9]+部分|^Part\s*[0-9]+"
_ENDS = "。！？；!?;"


def lines(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, line_no (from 1), line without white space around it."""
    return docs.select(*ids, F.posexplode(F.split(F.col(text), "\n")).alias("n", "raw")).select(*ids, (F.col("n") + 1).alias("line_no"), F.regexp_replace("raw", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("line"))


def heading_level(line: Column) -> Column:
    """Level of a heading line, else null: Markdown up to three (an item `商品 N` counts as three), 第N章 and 第N节,
    numbers with dots, a short numbered line, 一、 with a space.  Noise titles are text."""
    hashes = F.length(F.regexp_extract(line, r"^(#{1,6})\s+.+", 1))
    item = line.rlike(r"^#{1,6}\s+商品\s*[0-9]+\s*[:：\s]*")
    level = (
        F.when(hashes > 0, F.when(item, F.least(hashes, F.lit(3))).when(hashes <= 3, hashes))
        .when(line.rlike(r"^第[一二三四五六七八九十百千0-9]+章"), 1)
        .when(line.rlike(r"^第[一二三四五六七八九十百千0-9]+节"), 2)
        .when(line.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\s"), 3)
        .when(line.rlike(r"^[0-9]+\.[0-9]+\s"), 2)
        .when(line.rlike(r"^[0-9]+\s") & (F.length(line) < 60), 1)
        .when(line.rlike(r"^[一二三四五六七八九十]+、\s"), 1)
    )
    noise = F.lit(False)
    for t in NOISE_TITLES:
        noise = noise | F.contains(F.lower(line), F.lit(t))
    return F.when(~noise, level).cast("int")


def heading_title(line: Column) -> Column:
    """The heading up to its first sentence end, without that mark."""
    return F.regexp_extract(F.regexp_replace(line, r"^#{1,6}\s+", ""), r"^([^。！？]*)", 1)


def heading_rest(line: Column) -> Column:
    """What follows the first sentence end of a heading line: the first text of its section."""
    return F.regexp_replace(F.regexp_extract(line, r"^[^。！？]*[。！？](.*)$", 1), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def headings(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    found = lines(docs, ids, text).withColumn("level", heading_level(F.col("line"))).where("level is not null")
    return found.select(*ids, "line_no", "level", heading_title(F.col("line")).alias("title"))


def sections(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, section (from 1), level, title, n_lines, chars: text between headings.  Lines before the first heading
    belong to no section; a document without any heading is one section.  Text behind the title on a heading line
    opens the section."""
    rows = lines(docs, ids, text).withColumn("level", heading_level(F.col("line")))
    doc = Window.partitionBy(*ids).orderBy("line_no")
    rows = rows.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(doc))
    any_ = F.max("section").over(Window.partitionBy(*ids))
    rows = rows.withColumn("n", any_).where("section > 0 or n = 0")
    body = F.when(F.col("level").isNull(), F.col("line")).otherwise(heading_rest(F.col("line")))
    return rows.groupBy(*ids, "section").agg(
        F.coalesce(F.min("level"), F.lit(1)).alias("level"),
        F.coalesce(F.max(F.when(F.col("level").isNotNull(), heading_title(F.col("line")))), F.lit(NO_HEADING)).alias("title"),
        F.sum(F.when(F.coalesce(body, F.lit("")) != "", 1).otherwise(0)).alias("n_lines"),
        F.sum(F.coalesce(F.length(body), F.lit(0))).alias("chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(body, F.lit("")) != "", F.struct("line_no", body.alias("line"))))), lambda x: x["line"]), "\n").alias("content"),
    )


def section_paths(found: DataFrame, ids: list[str]) -> DataFrame:
    """Sections with the titles above them: of every smaller level the last heading, unless one of a level
    at most as deep came after it.  Behind a group title (第N部分, Part N) only that one stands above.  Windows per level, no fold."""
    order = Window.partitionBy(*ids).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    group = F.col("title").rlike(GROUP_TITLE)
    at = {n: F.max(F.when(F.col("level") == n, F.struct("section", "title"))).over(order) for n in (1, 2)}
    rows = found.withColumns({f"__l{n}": c for n, c in at.items()} | {"__g": F.max(F.when(group, F.struct("section", "title"))).over(order)})
    one = F.when(F.col("level") > 1, F.col("__l1.title"))
    two = F.when((F.col("level") > 2) & (F.coalesce(F.col("__l1.section"), F.lit(0)) < F.col("__l2.section")), F.col("__l2.title"))
    path = F.when(group, F.col("title")).when(F.col("__g").isNotNull(), F.concat_ws(" · ", "__g.title", "title")).otherwise(F.concat_ws(" · ", one, two, F.col("title")))
    return rows.withColumn("path", path).drop("__l1", "__l2", "__g")


def list_items(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """Numbered lines of each document (1. or 1、, 一、, 【1】, ①, ### 1.1), of documents with at least three."""
    kind = (
        F.when(F.col("line").rlike(r"^[0-9]+[.、:：]\s*\S"), "number").when(F.col("line").rlike(r"^[一二三四五六七八九十]+、"), "han").when(F.col("line").rlike(r"^【[^】]*[0-9]+[^】]*】"), "bracket")
        .when(F.col("line").rlike(r"^[①②③④⑤⑥⑦⑧⑨⑩]"), "circle").when(F.col("line").rlike(r"^#{3,}\s*[0-9]+\.[0-9]+"), "heading")
    )
    rows = lines(docs, ids, text).withColumn("kind", kind).where("kind is not null")
    n = F.count("*").over(Window.partitionBy(*ids, "kind"))
    return rows.withColumn("n", n).where("n >= 3").select(*ids, "kind", "line_no", F.length("line").alias("chars"))


def units(paragraph: Column) -> Column:
    """Sentences of a paragraph, none over a line's end; a short one goes on with the next, the last short one belongs to the one before."""
    sentence = rf"[^{_ENDS}\n]*[{_ENDS}]|[^{_ENDS}\n]+"
    found = F.filter(F.transform(F.regexp_extract_all(paragraph, F.lit(sentence), 0), strip), lambda x: x != "")
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def add(acc: Column, x: Column) -> Column:
        more = F.concat(acc["open"], F.when(acc["open"] != "", " ").otherwise(""), x)
        full = F.length(more) >= LEAST_SENTENCE
        return state(F.when(full, F.concat(acc["done"], F.array(more))).otherwise(acc["done"]), F.when(full, "").otherwise(more))

    def close(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.concat(F.slice(acc["done"], 1, n - 1), F.array(F.concat_ws(" ", F.element_at(acc["done"], -1), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(last)

    return F.aggregate(found, state(_no_texts(), F.lit("")), add, close)


def pack(text: Column, size: int = CHILD_CHARS) -> Column:
    """Chunks of at most ``size`` characters (a longer unit stays whole): a chunk ends where the next unit has no room, and at
    the end of a paragraph if it has LEAST_TAIL characters.  One fold over the units, each with whether it ends its paragraph."""
    marked = F.transform(
        F.transform(F.split(text, "\n\n"), units),
        lambda p: F.transform(p, lambda u, i: F.struct(u.alias("unit"), (i == F.size(p) - 1).alias("ends"))),
    )
    state = lambda out, now: F.struct(out.alias("out"), now.alias("now"))

    def add(acc: Column, x: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(x["unit"]) <= size)
        now = F.when(fits, F.concat(acc["now"], F.when(acc["now"] != "", " ").otherwise(""), x["unit"])).otherwise(x["unit"])
        out = F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"])))
        done = x["ends"] & (F.length(now) >= LEAST_TAIL)
        return state(F.when(done, F.concat(out, F.array(now))).otherwise(out), F.when(done, "").otherwise(now))

    return F.aggregate(F.flatten(marked), state(_no_texts(), F.lit("")), add, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def chunks(texts: DataFrame, ids: list[str], title: str, text: str, size: int = CHILD_CHARS) -> DataFrame:
    """ids, chunk_index, content: packed chunks with the title before each."""
    rows = texts.where(F.trim(text) != "").select(*ids, F.coalesce(title, F.lit("")).alias("__title"), F.posexplode(pack(F.col(text), size)).alias("chunk_index", "__chunk"))
    return rows.select(*ids, "chunk_index", F.concat(F.lit("[章节: "), F.col("__title"), F.lit("]\n\n"), F.col("__chunk")).alias("content"))


def parent_windows(children: DataFrame, doc: str = "doc_id", order: str = "place", width: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """doc, win, first, last, n: windows of ``width`` children at every ``stride``; the tails are kept.
    A child at place j (from 0) lies in every window w with w * stride <= j < w * stride + width: it is
    sent to those, so no window is looked for."""
    j = F.col(order)
    low = F.greatest(F.lit(0), F.ceil((j - (width - 1)) / stride)).cast("int")
    rows = children.withColumn("win", F.explode(F.sequence(low, F.floor(j / stride).cast("int"))))
    return rows.groupBy(doc, "win").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def places(children: DataFrame) -> DataFrame:
    """Children of each document once, numbered by chunk_index from 0."""
    once = children.select("doc_id", "child_id", "chunk_index", "content").where("doc_id is not null").distinct()
    return once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("chunk_index"), "child_id")) - 1)


def document_mode(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, n_lines, signals, products, mode: documents with two lines about products, or a tenth of their lines, are cut by
    topic; of the others those with three structure signals by structure, the rest by topic.  A text without a line has no row."""
    rows = lines(docs, ids, text).where("line <> ''")
    signal = heading_level(F.col("line")).isNotNull() | F.col("line").rlike(r"^(?:[0-9]+[.、]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|【)")
    per = rows.groupBy(*ids).agg(F.count("*").alias("n_lines"), F.sum(signal.cast("int")).alias("signals"), F.sum(F.col("line").rlike("|".join(PRODUCT_WORDS)).cast("int")).alias("products"))
    topic = (F.col("products") >= 2) | (F.col("products") > F.col("n_lines") * 0.1)
    return per.withColumn("mode", F.when(~topic & (F.col("signals") >= 3), "structure").otherwise("topic"))


def outline(chapters: DataFrame) -> DataFrame:
    """Of each title path with at least three direct children their number and titles: an equality join on the path
    one part shorter."""
    parts = F.split("chapter_title", " · ")
    c = chapters.select("doc_id", "chapter_title").where("chapter_title is not null").distinct()
    c = c.withColumn("above", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " · "))).where("above is not null")
    return c.groupBy("doc_id", "above").agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_set(F.element_at(parts, -1))), "|").alias("titles")).where("n_children >= 3")
