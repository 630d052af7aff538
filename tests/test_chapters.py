from pyspark.sql import functions as F

from heronry.operators import chapters, markdown, search, sessions, structure, telemetry


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, line string").drop("line")


def test_headings_go_down(spark):
    df = docs(spark, "# A\n# B\n## 1. C\n## D\n### E\ntext", "", None, "no heading")
    got = {r.line_no: r.demoted for r in chapters.demoted(df, ["id"], "text").collect()}
    assert got == {1: "# A", 2: "### B", 3: "### 1. C", 4: "## D", 5: "### E"}


def test_numerals(spark):
    words = {"三": 3, "十": 10, "十二": 12, "二十": 20, "一百零五": 105, "两千三百": 2300, "17": 17, "零": 100}
    df = spark.createDataFrame(list(words.items()), "w string, n int")
    assert {r.w: r.x for r in df.select("w", chapters.numeral(F.col("w")).alias("x")).collect()} == words


def test_a_document_pasted_twice(spark):
    part = "\n".join(f"第{n}章 t\nbody" for n in ("一", "二", "三", "四", "五", "六"))
    df = docs(spark, part, part + "\n" + part, "第一章 a\n第二章 b", None, "")
    assert [(r.id, r.top, r.cut_line) for r in chapters.pasted_twice(df, ["id"], "text").collect()] == [(1, 6, 13)]


def test_topics_of_paragraphs(spark):
    df = docs(spark, "商品的客服\n第二行\n \n会员\r\n\r\n天气\n\n\n配送 会员", None, "  ", "")
    got = {(r.id, r.topic): (r.first, r.n) for r in chapters.topics(df, ["id"], "text").collect()}
    assert {k: n for k, (_, n) in got.items()} == {(0, "商品与产品"): 1, (0, "会员与积分"): 2, (0, "其他内容"): 1}
    assert got[0, "商品与产品"][0] < got[0, "会员与积分"][0] < got[0, "其他内容"][0]


def test_contents_of_chapters(spark):
    rows = [(1, 1, 1, "A", "A", "x"), (1, 2, 2, "B", "A · B", "first\nmore"), (1, 3, 2, "C", "A · C", ""), (1, 4, 3, "D", "A · C · D", None), (1, 5, 2, "E", "A · E", "y" * 200), (1, 6, 3, "F", "A · E · F", "z")]
    df = spark.createDataFrame(rows, "id int, section int, level int, title string, path string, content string")
    got = chapters.contents(df, ["id"]).collect()
    assert [(r.section, r.n_children) for r in got] == [(1, 3)]
    assert got[0].contents == "【本章包含以下3个子章节】\nB - first\nC\nE - " + "y" * 150 + "..."
    assert chapters.contents(df.limit(0), ["id"]).count() == 0


def test_group_titles_stand_alone(spark):
    df = docs(spark, "# 总\n# 第一部分 a\n## b\n# 第二部分 c\n### d")
    got = {r.section: r.path for r in structure.section_paths(structure.sections(df, ["id"], "text"), ["id"]).collect()}
    assert got == {1: "总", 2: "第一部分 a", 3: "第一部分 a · b", 4: "第二部分 c", 5: "第二部分 c · d"}


def test_lists_are_packed_whole(spark):
    items = [10, 20, 600, 700, 10, 10, 10, 10, 10, 790]
    text = "intro\n" + "\n".join(f"{i}. ".ljust(n, "x") for i, n in enumerate(items, 1))
    got = [(r["first"], r["last"], r.chars) for r in chapters.list_chunks(docs(spark, text, "1. a\n2. b", None, ""), ["id"], "text").orderBy("chunk").collect()]
    # by hand: a long item stands alone only where it would open a chunk
    want, batch = [], []
    for i, n in enumerate(items, 1):
        if batch and (len(batch) >= 4 or sum(x for _, x in batch) + n > 800):
            want.append((batch[0][0], batch[-1][0], sum(x for _, x in batch)))
            batch = [(i, n)]
        elif not batch and n > 500:
            want.append((i, i, n))
        else:
            batch.append((i, n))
    if batch:
        want.append((batch[0][0], batch[-1][0], sum(x for _, x in batch)))
    assert got == want and sum(b - a + 1 for a, b, _ in got) == len(items)


def test_parents_without_doubles(spark):
    long = "甲" * 200
    rows = [("q", "p1", long, 0.9, 0.9, 1), ("q", "p2", long + "乙" * 50, 0.8, 0.8, 1), ("q", "p3", "短", 0.7, 0.7, 1), ("q", "p4", "短 ", 0.7, 0.7, 1), ("q", "p5", "", 1.0, 1.0, 1), ("q", "p6", None, 1.0, 1.0, 1), ("q", "p7", "别的", 0.9, 2.0, 3), ("r", "p1", long, 0.1, 0.1, 1)]
    df = spark.createDataFrame(rows, "query_id string, parent_id string, content string, best double, total double, n int")
    got = [(r.query_id, r.parent_id) for r in search.without_doubles(df.unionByName(df)).orderBy("query_id", "place").collect()]
    assert got == [("q", "p7"), ("q", "p1"), ("q", "p3"), ("r", "p1")]
    assert search.without_doubles(df.limit(0)).count() == 0


def test_hybrid_search_fuses_two_arms(spark):
    w = spark.createDataFrame([(i, t, x) for i, t, x in [(1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0), (3, "c", 1.0)]], "id long, token string, weight double")
    q = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5), ("none", "zz", 1.0)], "query_id string, token string, weight double")
    got = {(r.query_id, r["rank"]): r.id for r in search.hybrid_search(q, w, 2).collect()}
    assert {got["q", 1], got["q", 2]} == {1, 2}


def test_quotes_and_keywords(spark):
    hits = spark.createDataFrame([("q", 1, 0.5, "退货，流程 退货"), ("q", 2, 0.1, "no"), ("r", 1, 0.2, None)], "query_id string, rank int, score double, content string")
    asked = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    got = {r.query_id: (r.n_quotes, r.answer) for r in search.quoted(hits, asked).collect()}
    assert got == {"q": (1, "[文档1]\n退货，流程 退货"), "r": (0, search.NO_ANSWER), "s": (0, search.NO_ANSWER)}
    assert [(r.query_id, r.word, r.n) for r in search.keywords(hits).orderBy(F.desc("n"), "word").collect()] == [("q", "退货", 2), ("q", "no", 1), ("q", "流程", 1)]


def test_hot_sessions_and_ranks_in_pieces(spark):
    """One session and one group with half of all rows, over many slots of time."""
    day = 86_400
    msgs = [(i, "hot" if i % 2 else f"s{i % 7}", "same" if i % 3 else f"m{i}", i * day // 4) for i in range(400)]
    df = spark.createDataFrame(msgs, "message_id int, session_id string, message string, sent_at int")
    per: dict = {}
    for i, s, m, _ in msgs:
        per.setdefault(s, []).append((i, m))
    spam = {x[k][0] for x in per.values() for k in range(2, len(x)) if x[k][1] == x[k - 1][1] == x[k - 2][1]}
    assert {r.message_id for r in sessions.repeats(df).where("is_spam").collect()} == spam
    kept = {i for x in per.values() for k, (i, m) in enumerate(x) if sum(len(m) for _, m in x) <= 100 or len(x) <= 10 or k < 2 or k >= len(x) - 8}
    assert {r.message_id for r in sessions.compressed(df, 100).collect()} == kept
    recs = spark.createDataFrame([("hot" if i % 2 else "s", float(i * i % 9973)) for i in range(4000)], "session_id string, ts double")
    want = 0
    for s in ("hot", "s"):
        t = sorted(float(i * i % 9973) for i in range(4000) if ("hot" if i % 2 else "s") == s)
        want += 1 + sum(b - a >= 20 for a, b in zip(t, t[1:]))
    got = telemetry.activity_windows(recs, 20.0, 50.0)
    assert got.count() == want and got.agg(F.sum("requests")).first()[0] == 4000


def test_lines_become_markdown(spark):
    want = {
        "12": None, "- 3 -": None, "第 4 页 x": None, "page 5": None, "© 2024": None, "# A": "# A", "第一章 总则": "## 第一章 总则", "第二章": "## 第二章", "2.1 手机": "### 2.1 手机", "【2.7 户外】": "### 2.7 户外",
        "【商品 004】锅": "#### 商品 004: 锅", "【查询】": "### 查询", "【好。】": "【好。】", "售后服务：七天": "#### 售后服务\n七天", "1. 短": "## 1. 短", "1. 有：冒号": "1. 有：冒号", "一、甲": "### 甲", "（二）乙": "#### 乙",
        "Chapter 3: Ends": "## Ends", "part 2": "## part 2", "Q：谁": "### 谁", "会员流程": "### 会员流程", "产品参数": "#### 产品参数", "技术参数": "#### 技术参数", "WARRANTY": "### WARRANTY", "如何退货": "### 如何退货",
        "如何退货？": "如何退货？", "普通的一行文字": "普通的一行文字",
    }
    df = docs(spark, "\n".join(want), "\n\n\na\n\n\nb", None, "")
    got = {(r.id, r.line_no): r.markdown for r in markdown.markdown_lines(df, ["id"], "text").collect()}
    assert {i: got.get((0, i)) for i in range(1, len(want) + 1)} == dict(enumerate(want.values(), 1))
    assert {n: m for (i, n), m in got.items() if i == 1} == {1: "", 4: "a", 5: "", 7: "b"} and {i for i, _ in got} == {0, 1, 3}


def test_mode_of_documents(spark):
    df = docs(spark, "# A\n# B\n# C\nx", "# A\n# B\n# C\n商品\n规格", "# A\n商品", "# A\n\nx", None, " ")
    assert {r.id: r.mode for r in structure.document_mode(df, ["id"], "text").collect()} == {0: "structure", 1: "topic", 2: "topic", 3: "topic"}
