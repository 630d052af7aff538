import random

from heronry.llm.leakage import Automaton, Searcher, approximate, blocks, leaks, located, normalise, stretches, take_out, without_leaks

ZH = "复核坐席发现登记表与莲塘验收点的实收数量相差超过四十件时接下来该走哪一步才算符合规定呢"
EN = "Holders of voucher may ask the second line supervisors to fill in the sheet which is stamped before half past eight on the same day in the main office"


def test_automaton_against_brute_force():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(3, 12))) for _ in range(7)]
    a = Automaton(texts)
    for _ in range(200):
        q = "".join(rnd.choice("abc") for _ in range(15))
        got = {i: (n, s) for i, s, n in a.matches(q)}
        for i in range(len(q)):
            n = max(k for k in range(i + 2) if k == 0 or any(q[i + 1 - k : i + 1] in t for t in texts))
            assert got.get(i, (0, 0))[0] == n
            if n:
                assert a.texts[got[i][1]] == {k for k, t in enumerate(texts) if q[i + 1 - n : i + 1] in t}


def test_approximate_against_brute_force():
    rnd = random.Random(2)

    def brute(p, t):
        row, best = list(range(len(p) + 1)), len(p)
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
            row, best = new, min(best, new[-1])
        return best

    for _ in range(300):
        p, t = [[rnd.choice("abc") for _ in range(n)] for n in (rnd.randint(1, 8), rnd.randint(0, 20))]
        for k in range(3):
            assert approximate(p, t, k) == (brute(p, t) <= k)


def test_limits():
    s = Searcher([("zh", ZH), ("en", EN)])
    assert s.leaks("前文。" + ZH[5:29] + "后文") == {("zh", "run", 24)}
    assert s.leaks("前文。" + ZH[5:28] + "后文") == set()
    assert {x[0] for x in s.leaks("<b>" + " ".join(ZH[:24]) + "</b>")} == {"zh"}
    wrong = list(ZH)
    for i in (6, 17, 28, 39):
        wrong[i] = "某"
    assert {(c, h) for c, h, _ in s.leaks("问：" + "".join(wrong) + "？")} == {("zh", "approximate")}
    wrong[33] = wrong[11] = wrong[23] = "某"
    assert s.leaks("".join(wrong)) == set()
    words = EN.split()
    words[4] = words[14] = "changed"
    assert {(c, h) for c, h, _ in s.leaks("Q: " + " ".join(words).upper() + "?")} == {("en", "approximate")}
    assert s.leaks("") == set() and s.leaks("?!") == set()


def test_normalise():
    assert normalise("Ａ​b-Ｃ <i>１２</i>&nbsp;退 货")[0] == "abc12退货"


def test_job(spark):
    rows = [(1, "x" + ZH, "c"), (2, "x" + ZH, "c"), (3, None, "c"), (4, "", "c"), (5, "nothing here", "c"), (6, ("长文" * 20000) + ZH, "c"), (None, ZH, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, case_id string")
    items = spark.createDataFrame([("zh", ZH, None, "x"), ("no", None, "", "x"), ("zh", ZH, None, "x")], "case_id string, question string, answer string, text string")
    got = leaks(docs, "doc_id", "text", items, "case_id", ["question", "answer"]).collect()
    assert {(r.id, r.case_id) for r in got} == {(1, "zh"), (2, "zh"), (6, "zh"), (None, "zh")}
    assert leaks(docs.limit(0), "doc_id", "text", items, "case_id", ["question"]).count() == 0
    assert leaks(docs, "doc_id", "text", items.limit(0), "case_id", ["question"]).count() == 0


def test_blocks_hold_all():
    items = [(str(i), "x" * 30) for i in range(10)]
    assert sum(blocks(items, 100), []) == items and max(map(len, blocks(items, 100))) == 3


def test_longest_run_and_its_span():
    s = Searcher([("zh", ZH), ("part", ZH[:30]), ("en", EN)])
    assert s.leaks("前文。" + ZH + "后文") == {("zh", "run", len(ZH)), ("part", "run", 30)}
    text = "前文，<b>" + ZH[:20] + " Ａ" + ZH[20:] + "</b>后文"
    assert {(c, h, text[a:b]) for c, h, a, b, _, _ in s.spans("头" + ZH + "尾") if c == "zh" and h == "run" for text in ["头" + ZH + "尾"]} == {("zh", "run", ZH)}
    near = [x for x in s.spans(text) if x[:2] == ("zh", "approximate")]
    assert [text[a:b] for _, _, a, b, _, _ in near] == [text[6:-6]] and near[0][5] == round(1 - 1 / len(ZH), 4)
    words = EN.split()
    words[4] = "changed"
    text = "Question: " + " ".join(words) + " or not"
    assert [text[a:b] for c, h, a, b, _, _ in s.spans(text) if h == "approximate"] == [" ".join(words)]
    assert s.spans("nothing") == [] and take_out("abcdef", [(1, 3), (2, 4), (2, 3)]) == "aef"


def test_places_of_letters():
    text = "Ａ​b-Ｃ <i>１２</i>&nbsp;退 货 [x](http://a) ﬁe\u0301ß ｶﾞ _"
    flat, starts, places = located(text)
    assert (flat, starts) == normalise(text) and len(places) == len(flat)
    assert text[slice(*places[flat.index("退")])] == "退" and text[slice(*places[flat.index("f")])] == text[slice(*places[flat.index("i", 5)])] == "ﬁ"


def test_stretches():
    assert stretches(list("abcdefghij"), list("xxabcdXfghijyyabcdefghijz"), 1) == [(2, 12, 1), (14, 24, 0)]
    assert stretches(list("abcdefghij"), list("zz"), 1) == []


def test_job_without_leaks(spark):
    docs = spark.createDataFrame([(1, "前，" + ZH + "。后"), (2, "短"), (3, None), (None, ZH)], "doc_id long, text string")
    items = spark.createDataFrame([("zh", ZH, None), ("no", None, "")], "case_id string, question string, answer string")
    got = {r.id: (r.text, [(s.case_id, s.start, s.end) for s in r.spans if s.how == "run"]) for r in without_leaks(docs, "doc_id", "text", items, "case_id", ["question", "answer"]).collect()}
    assert got == {1: ("前，。后", [("zh", 2, 2 + len(ZH))]), 2: ("短", []), 3: (None, []), None: ("", [("zh", 0, len(ZH))])}


def test_markup_of_any_length_is_no_break():
    text = "满足条件的订单可以在签收后七天之内申请退货并且不收取任何费用"
    s = Searcher([("c", text)])
    for n in (10, 300, 5000):
        for mark in (f"<span class='{'x' * n}'>", f"[](http://{'y' * n})"):
            assert {c for c, _, _ in s.leaks(text[:15] + mark + text[15:])} == {"c"}
            assert [how for _, how, *_ in s.spans(text[:15] + mark + text[15:])] != []
