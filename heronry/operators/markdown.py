"""Raw text as Markdown: every line is classified by the first of a list of rules that fits, as one expression.

A rule is a pattern, the length that a line must stay below, a pattern that it must not have, and what
becomes of it.  The same list makes the SQL of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.operators.structure import lines

# The patterns of lines that go, of titles with their level, and the words that tell titles.
DROPPED = r"^-?\s*[0-9]{1,4}\s*-?$|^第\s*[0-9]+\s*页|^(?i:Page\s+[0-9]+)|^©|^(?i:Confidential)"
KEYWORDS = ("商品编号", "商品品牌", "商品售价", "商品简介", "详细规格", "补充说明", "售后保障", "保修政策", "配送方式", "包装清单", "商品编号前缀", "主要商品类型", "适用人群", "核心卖点", "发票说明", "售后服务", "退换说明", "安装服务")
ENDINGS = ("介绍", "说明", "指南", "服务", "政策", "功能", "特点", "参数", "概述", "要求", "流程", "步骤", "方法")
DEEPER = ("介绍", "说明", "指南", "流程", "步骤", "服务", "政策", "功能", "特点", "要求", "规范", "类型", "分类", "使用", "操作", "配置")
DEEPEST = ("补充", "备注", "附录", "参考", "示例", "注意事项", "详情", "参数", "规格")
OPENINGS = ("常见问题", "注意事项", "FAQ", "产品介绍", "使用说明", "售后服务", "技术参数")
QUESTIONS = ("什么是", "为什么", "如何", "什么")
RULES = (
    (r"^(#{1,6}\s+.+)$", None, None, r"\1"),
    (r"^(第[一二三四五六七八九十百千0-9]+[章节篇部])\s*(.*)$", 80, None, r"## \1 \2"),
    (r"^([0-9]+\.[0-9]+\s+.+)$", 80, None, r"### \1"),
    (r"^[【\[]\s*([0-9]+\.[0-9]+)\s*(.+?)\s*[】\]]$", 80, None, r"### \1 \2"),
    (r"^[【\[]\s*([^】\]]*?[0-9]+[^】\]]*?)\s*[】\]]\s*(.+)$", 150, None, r"#### \1: \2"),
    (r"^[【\[]\s*([^】\]]+?)\s*[】\]]$", 60, "[。！]", r"### \1"),
    (rf"^({'|'.join(KEYWORDS)})\s*[:：]\s*(.*)$", None, None, "#### \\1\n\\2"),
    (r"^([0-9]+\s*[.、]\s+.+)$", 50, "[:：]", r"## \1"),
    (r"^[一二三四五六七八九十百]+、\s*(.+)$", 60, None, r"### \1"),
    (r"^[（(][一二三四五六七八九十百0-9]+[）)]\s*(.+)$", 60, None, r"#### \1"),
    (r"^(?i:Section|Part|Chapter)\s*[0-9]+[.、:：]*\s*(.+)$", 80, None, r"## \1"),
    (r"^((?i:Section|Part|Chapter)\s*[0-9]+[.、:：]*)$", 80, None, r"## \1"),
    (r"^(?:Q[.、:：]|问题[：:])\s*(.+)$", 80, None, r"### \1"),
)
#: A title by its words is 2 to 20 characters long, has no mark at its end and no text behind a colon.
TITLE_CHARS, NO_TITLE = (2, 20), r"[。，；：:,;）)！？!?]$|^.+[：:]\s*.+"
TITLES = (
    (rf"^[一-龥A-Za-z]{{2,15}}(?:{'|'.join(ENDINGS)})$", ((f"{'|'.join(DEEPER)}", "###"), (f"{'|'.join(DEEPEST)}", "####"), ("", "##"))),
    (rf"^(?:{'|'.join(OPENINGS)})", (("介绍|说明|服务|流程|问题|功能|特点|^FAQ$", "###"), ("补充|注意事项|备注", "####"), ("", "##"))),
    (r"^[A-Z][A-Z\s]{3,30}$", (("", "###"),)),
    (rf"^(?:{'|'.join(QUESTIONS)}).{{0,17}}$", (("", "###"),)),
)


def markup(line: Column) -> Column:
    """The Markdown of a line without white space around it; null for page numbers and running lines."""
    out = F.when(line.rlike(DROPPED), F.lit(None).cast("string"))
    for pattern, below, without, to in RULES:
        fits = line.rlike(pattern)
        fits = fits & (F.length(line) < below) if below else fits
        fits = fits & ~line.rlike(without) if without else fits
        out = out.when(fits, F.trim(F.regexp_replace(line, pattern, to.replace("\\", "$"))))
    short = F.length(line).between(*TITLE_CHARS) & ~line.rlike(NO_TITLE)
    for pattern, levels in TITLES:
        level = None
        for words, hashes in levels:
            hit = line.rlike(words) if words else F.lit(True)
            level = F.when(hit, hashes) if level is None else level.when(hit, hashes)
        out = out.when(short & line.rlike(pattern), F.concat_ws(" ", level, line))
    return out.otherwise(line)


def sql_markup(line: str) -> str:
    """The same for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"WHEN regexp_matches({line}, {quote(DROPPED)}) THEN NULL"]
    for pattern, below, without, to in RULES:
        fits = f"regexp_matches({line}, {quote(pattern)})" + (f" AND length({line}) < {below}" if below else "") + (f" AND NOT regexp_matches({line}, {quote(without)})" if without else "")
        parts.append(f"WHEN {fits} THEN trim(regexp_replace({line}, {quote(pattern)}, {quote(to)}))")
    short = f"length({line}) BETWEEN {TITLE_CHARS[0]} AND {TITLE_CHARS[1]} AND NOT regexp_matches({line}, {quote(NO_TITLE)})"
    for pattern, levels in TITLES:
        level = " ".join(f"WHEN regexp_matches({line}, {quote(words)}) THEN {quote(h)}" if words else f"ELSE {quote(h)}" for words, h in levels)
        level = f"CASE {level} END" if len(levels) > 1 else quote(levels[0][1])
        parts.append(f"WHEN {short} AND regexp_matches({line}, {quote(pattern)}) THEN {level} || ' ' || {line}")
    return f"CASE {' '.join(parts)} ELSE {line} END"


def markdown_lines(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, line_no, markdown: the lines of each text as Markdown, without page numbers and running lines; of blank lines in a
    row the first stays.  Null and empty texts give at most one blank line."""
    rows = lines(docs, ids, text)
    before = F.lag("line").over(Window.partitionBy(*ids).orderBy("line_no"))
    rows = rows.withColumn("before", before).where("line <> '' or before is null or before <> ''")
    return rows.select(*ids, "line_no", markup(F.col("line")).alias("markdown")).where("markdown is not null")
