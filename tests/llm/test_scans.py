import random

from heronry.llm.scans import Trie, accepted, candidates, classify, confusions, edit, joins_next, near, noisy_lines, page_number, repaired, repaired_documents, split_known
from heronry.llm.scans import _han_verdicts as han_verdicts
from heronry.llm.scans import _word_verdicts as word_verdicts

BODY = ["价格保护以下单时的成交价为准，差额折成积分。", "电子发票在确认收货后由会员组开具，会发送到邮箱。", "同一账号重复申请换货超过次数，会进入人工抽检。", "Reward points are restored after an exchange is completed and vouchers keep their validity."]


def pages(spark):
    rnd = random.Random(1)
    rows = []
    for d in range(12):
        for p in range(1, 5):
            text = [rnd.choice(BODY) for _ in range(12)]
            head = ["值班手册"] if p > 1 else ["值班手册"]
            rows.append((f"doc{d}", p, "\n".join([*head, *text, "内部资料 请勿外传", f"- {p} -"]), {"ocr": "true"}, "x"))
    dirty = ["值班手册", "价格保护以下草时的成交价为准，差额折成积分。", BODY[3].replace("points", "p0ints"), "Reward points are restored after an exchange is com-", "pleted and vouchers keep their validity.", "303", "384", "responsible party -", "the rest is LG-", "12 items", "", "内部资料 请勿外传", "- 5 -"]
    rows.append(("doc0", 5, "\n".join(dirty), None, "x"))
    rows.append(("doc0", 5, "\n".join(dirty), None, "x"))
    rows += [("digital", 1, "值班手册\nself-\nservice\n- 1 -", {"ocr": "false"}, "x"), ("none", 1, None, None, "x"), ("empty", 1, "", {}, "x"), (None, 1, "x", None, "x")]
    return spark.createDataFrame(rows, "doc_id string, page_num int, text string, metadata map<string,string>, kind string")


def test_kinds_of_lines(spark):
    got = {(r.line_no, r.kind) for r in noisy_lines(pages(spark)).where("doc_id = 'doc0' and page_num = 5").collect()}
    assert got == {(1, "header"), (2, "misread"), (3, "misread"), (4, "hyphen"), (12, "header"), (13, "page_no")}
    first = {(r.line_no, r.kind) for r in noisy_lines(pages(spark)).where("doc_id = 'doc1' and page_num = 1").collect()}
    assert (1, "header") not in first and {k for _, k in first} == {"header", "page_no"}
    assert noisy_lines(pages(spark)).where("doc_id in ('digital', 'none', 'empty')").count() == 0


def test_repair(spark):
    clean = {(r.doc_id, r.page_num): r.clean for r in repaired(pages(spark)).collect()}["doc0", 5]
    assert "下单时" in clean and "points are restored after an exchange is completed and vouchers" in clean and "p0ints" not in clean
    assert "内部资料" not in clean and "值班手册" not in clean


def verdicts(spark, entries, seen):
    """What the vocabulary (sort, entry, n, clean) says of marked words and stretches (kind, entry, before, after, offset)."""
    counts = spark.createDataFrame(entries, "sort string, entry string, n long, clean long")
    found = candidates(counts)
    fit = accepted(found, confusions(found))
    rows = spark.createDataFrame(seen, "kind string, entry string, before string, after string, offset int")
    return {(r.entry, r.before): r.right for r in word_verdicts(rows, counts, fit).collect()} | {(r.entry, r.offset): r.right for r in han_verdicts(rows, counts, fit).collect()}


def stretches(text, n, clean=0):
    return [("h", text[i : i + 4], n, clean) for i in range(len(text) - 3)]


def test_frequent_misreadings_are_found_at_any_size(spark):
    for times in (1, 10, 1000):
        entries = [("w", "hours", 2500), ("w", "bours", 6), ("w", "yours", 600), ("w", "of", 300_000), ("b", "48 hours", 900), ("b", "hours of", 900), ("b", "is yours", 300), ("b", "48 bours", 3)]
        got = verdicts(spark, [(sort, entry, n * times, 0) for sort, entry, n in entries], [("w", "bours", "48", "of", 0), ("w", "yours", "is", "of", 0), ("w", "hours", "48", "of", 0)])
        assert got == {("bours", "48"): "hours"}


def test_genuine_minority_wordings_stay_at_any_size(spark):
    """A wording that differs in one character from a frequent one is no misreading: no other wording asks for the same swap."""
    for n in (2, 200, 20_000):
        entries = stretches("第9章总则A", 20 * n) + [x for x in stretches("第9章附则A", n) if "附" in x[1]]
        assert verdicts(spark, entries, [("h", "第9章附则A", "", "", 3)]) == {}
        # nor is it if pages without misreadings have it, though the swap is a known one
        known = [x for i in range(30) for x in [*stretches(f"甲{chr(0x5000 + i)}单乙丙", 20 * n), *stretches(f"甲{chr(0x5000 + i)}草乙丙", n)]]
        wrong = stretches("丁戊单己庚", 40 * n) + stretches("丁戊草己庚", n, clean=1)
        assert verdicts(spark, known + wrong, [("h", "甲倀草乙丙", "", "", 2), ("h", "丁戊草己庚", "", "", 2)]) == {("甲倀草乙丙", 2): "单"}


def test_words_of_other_lengths_and_with_digits(spark):
    entries = [("w", "warehouse", 900, 90), ("w", "the", 90_000, 900), ("w", "desk", 3000, 30), ("b", "the warehouse", 800, 80), ("b", "warehouse desk", 300, 30), ("w", "304", 700, 70), ("b", "room 304", 70, 7)]
    bad = ["warehuse", "warehousse", "warehouxe"]
    entries += [("w", w, 1, 0) for w in [*bad, "3o4"]] + [("w", "warehouses", 4, 2)]
    seen = [("w", w, "the", "desk", 0) for w in [*bad, "warehouses"]] + [("w", "3o4", "room", "of", 0)]
    assert verdicts(spark, entries, seen) == {(w, "the"): "warehouse" for w in bad} | {("3o4", "room"): "304"}


def test_misread_characters_are_replaced_at_their_place(spark):
    rows = [(f"doc{d}", 1, "\n".join(["以下单时的成交价为准，差额折成积分，以下单时 AB-5 的差额。"] * 20), {"ocr": "true"}) for d in range(20)]
    rows.append(("x", 1, "　　草稿 12 份，以下草时的成交价为准，以下草时 LG-5 的差额", {"ocr": "true"}))
    got = repaired(spark.createDataFrame(rows, "doc_id string, page_num int, text string, metadata map<string,string>"))
    assert [r.clean for r in got.where("doc_id = 'x'").collect()] == ["草稿 12 份，以下单时的成交价为准，以下单时 LG-5 的差额"]
    # pages without misreadings keep every character
    clean = {r.clean.replace("\n", "") for r in got.where("doc_id <> 'x'").collect()}
    assert clean == {"以下单时的成交价为准，差额折成积分，以下单时 AB-5 的差额。" * 20}


def test_repair_of_every_version(spark):
    rows = pages(spark)
    texts = {p: t for p, t in rows.where("doc_id = 'doc0'").select("page_num", "text").distinct().collect()}
    whole = "\n".join(texts[p] for p in sorted(texts))
    old = whole[: whole.index("responsible party")]
    docs = [("doc0", 2, whole, "pdf"), ("doc0", 2, whole, "pdf"), ("doc0", 1, old, "pdf"), ("doc0", 0, None, "pdf"), ("digital", 1, "值班手册\nself-\nservice", "pdf"), ("none", 1, " ", "pdf")]
    got = repaired_documents(spark.createDataFrame(docs, "doc_id string, doc_version int, raw_text string, file_type string"), rows).collect()
    assert sorted((r.doc_id, r.doc_version) for r in got) == [("doc0", 1), ("doc0", 2)]
    for r in got:
        assert "下单时" in r.clean and "points are restored after an exchange is completed and vouchers" in r.clean and "p0ints" not in r.clean
        assert "内部资料" not in r.clean and r.clean.count("值班手册") == 1 and "- 3 -" not in r.clean
    assert repaired_documents(spark.createDataFrame([], "doc_id string, doc_version int, raw_text string, file_type string"), rows).count() == 0


def test_pages_of_a_whole_text():
    known = [(1, "a\nb"), (2, ""), (3, "c\nd")]
    assert split_known("a\r\nb\n\nc\nd", known, [], set()) == [(1, "a\nb", True), (2, "", True), (3, "c\nd", True)]
    assert split_known("a\nb\n\nc", known, [], set()) == [(1, "a\nb", True), (2, "", True), (3, "c", True)]
    assert split_known("a\nb\n\nm\n- 3 -\ntitle\ny", known, ["title"], {0}) == [*[(1, "a\nb", True), (2, "", True)], (3, "m\n- 3 -", False), (4, "title\ny", False)]
    assert "\n".join(t for _, t, _ in split_known("m\nPage 1\ny\nPage 2\nz", [], [], set())) == "m\nPage 1\ny\nPage 2\nz"


def test_empty(spark):
    assert noisy_lines(pages(spark).limit(0)).count() == 0


def test_automaton_against_brute_force():
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))): 1 for _ in range(60)}
    trie = Trie(words)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(60):
        q = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6)))
        for most in (0, 1, 2):
            assert {(w, d) for w, d, _ in trie.within(q, most)} == {(w, distance(q, w)) for w in words if distance(q, w) <= most}


def test_edits():
    assert edit("hours", "bours") == (0, "h", "b") and edit("month", "rnonth") == (0, "m", "rn") and edit("a", "aa") == (1, "", "a")


def test_small_parts():
    assert [page_number(x) for x in ("- 3 -", "iv", "第四十五页", "Page 2 of 9", "共7页 第1页", "〔12〕", "3 kg", "第三章")] == [3, 4, 45, 2, 1, 12, None, None]
    assert joins_next("an exchange is com-", "pleted") and joins_next("the self-", "service desk") and not joins_next("party -", "the") and not joins_next("LG-", "12") and not joins_next("a code X9-", "abc")
    assert near("after-sales s†andard", "after-sales standard") and not near("abc", "abd")
    assert classify(["T", "T", "text。"], True, 1, [("t", False)], set()) == {0: "header"}
