from heronry.llm.privacy import Own, entities, find_candidates, sanitise
from heronry.llm.privacy_queries import SHOP

SEEDS = [f"我叫{s}{g}，谢谢" for s in "王李张刘陈魏" for g in ("栖泠", "沐煦", "澍予", "棠翊")] + [f"my name is {a} {b}" for a in ("Imke", "Corwin", "Tamsin") for b in ("Tallis", "Okhuysen")]
PLAIN = ["订单 2026010857018797 还没到", "条码 69207009211 扫不出来", "任务没完成，安排一下", "听槐路那边的自提点几点关门", "please check the Greenstag Parcel parcel", "我打了热线 400-555-071", "给 service@larkmoor.example 写过信"] * 6
CASES = {
    1000: ("魏栖泠的退款还没到", {"name"}),
    1001: ("邮箱 ab_1962 (at) example dot org", {"email"}),
    1002: ("call +44 20 7946 0715 or 154-0368-6611", {"phone"}),
    1003: ("身份证：310192-19571202-8553，一五四四一五四七零八零", {"idno", "phone"}),
    1004: ("寄到栖川市松栖区锦鳞大道9弄84号2763", {"address"}),
    1005: ("leave it at 970 Tannery Row, Apt 16D thanks", {"address"}),
    1006: ("refund goes to Imke Okhuysen", {"name"}),
    1007: ("报关用６１０１９７１９６６０４１６２３６５", {"idno"}),
}

def messages(spark):
    rows = [(i, t) for i, t in enumerate(SEEDS + PLAIN)] + [(i, t) for i, (t, _) in CASES.items()]
    rows += [(2000, None), (2001, "  "), (2002, "长" * 50000), (1000, CASES[1000][0]), (None, "我叫王沐煦")]
    return spark.createDataFrame([(*r, "x") for r in rows], "message_id long, message string, kind string")

def test_kinds(spark):
    got = {}
    for r in entities(messages(spark), "message_id", "message", SHOP).collect():
        got.setdefault(r.id, set()).add(r.kind)
    for i, (_, kinds) in CASES.items():
        assert got.get(i, set()) == kinds, i
    plain = range(len(SEEDS), len(SEEDS) + len(PLAIN))
    assert not any(i in got for i in plain) and got[0] == {"name"} and got[None] == {"name"} and 2002 not in got

def test_placeholders_keep_the_rest(spark):
    df = messages(spark)
    clean = {r.id: r for r in sanitise(df, "message_id", "message", entities(df, "message_id", "message", SHOP)).collect()}
    assert clean[1000].clean == "[NAME]的退款还没到"
    assert clean[1004].clean == "寄到[ADDRESS]"
    assert clean[1002].clean == "call [PHONE] or [PHONE]" and clean[1002].n_entities == 2
    assert clean[2000].clean is None and clean[2001].clean == "  "
    assert clean[len(SEEDS)].clean == PLAIN[0]

def test_spans_are_those_of_the_text():
    for t, _ in CASES.values():
        assert all(t[a:b] == s for _, a, b, s, *_ in find_candidates(t))

def test_empty(spark):
    assert entities(messages(spark).limit(0), "message_id", "message").count() == 0

def test_names_of_any_length():
    def cut(t):
        return {s for _, _, _, s, *_ in find_candidates(t)}

    assert "令狐冲" in cut("我叫令狐冲") and "欧阳娜娜" in cut("找欧阳娜娜谢谢") and "Anna Maria Lopez" in cut("my name is Anna Maria Lopez.")

def test_disclosure_refuses_what_only_looks_like_an_entity(spark):
    """A street word that never stands where addresses stand, a place with a number and a handle are refused; the same patterns pass where they disclose."""
    way = "甲乙丙丁戊己庚辛壬癸"
    rows = [f"请寄到{way[i % 10]}{way[i // 10]}路{i + 1}号，谢谢" for i in range(60)] + [f"{way[i % 10]}{way[i // 10]}胡同{i + 1}号 这首歌真好听" for i in range(60)]
    rows += [f"批次{i}号 还在吗" for i in range(60)] + [f"邮箱 ab{i}@mail.example" for i in range(60)] + [f"cd{i}@home 是什么" for i in range(60)] + [f"给 ef{i}@shop.example 写过信" for i in range(60)]
    rows += ["就在子丑路7号那边", "gh@post.example 可以吗"]
    df = spark.createDataFrame(list(enumerate(rows)), "message_id long, message string")
    found = {rows[r.id][:2] for r in entities(df, "message_id", "message", Own(("shop.example",))).where("kind in ('address', 'email')").collect()}
    assert {"请寄", "邮箱", "就在", "gh"} <= found
    assert not any(f"{a}{b}" in found for a in way for b in way) and "批次" not in found and "cd" not in found and "给 " not in found
