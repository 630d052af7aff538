import random

import numpy as np

from heronry.llm.abuse import LETTERS, Network, Scorer, _arrays, fit, fitted, plain, ratings, score, spans, steps, train

BAD = ["你们客服就是个白痴，滚远点。", "真是蠢货，连个杯子都发错。", "Shut up you idiot, nobody wants you here.", "你这种人渣去死吧。", "what a lying bastard, get lost."]
GOOD = ["快递送得挺快，包装完好。", "请问发票可以重新开吗？", "The parcel arrived on time and works well.", "总体打八分，扣分是因为说明书缺页。", "社区规范禁止辱骂和歧视。", "Please check my order, it is late."]


def corpus(n=260, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        parts = [rnd.choice(GOOD) for _ in range(rnd.randint(2, 6))]
        bad = i % 3 == 0
        if bad:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(BAD))
        out.append(("\n".join(parts), 1.0 if bad else 0.0))
    return out


def test_gradients():
    net = Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    batch = _arrays([list("你是谁啊白痴"), ["shut", "up", "you"]])
    y, w = np.array([1, 0]), np.array([1.0, 2.0])
    _, g = net.gradients(*batch, y, w)
    for k in net.p:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, e = net.p[k][i], 1e-4
        net.p[k][i] = old + e
        up, _ = net.gradients(*batch, y, w)
        net.p[k][i] = old - e
        down, _ = net.gradients(*batch, y, w)
        net.p[k][i] = old
        assert abs((up - down) / 2 / e - g[k][i]) < 1e-4 * max(1, abs(g[k][i])) + 1e-5, k


def test_held_out_accuracy_and_spellings():
    net = train(corpus(), limit=1200, epochs=10)
    s = Scorer(net)
    held = corpus(120, 9)
    got = np.array(s.scores([t for t, _ in held])) >= 0.6
    assert np.mean(got == np.array([y > 0.5 for _, y in held])) >= 0.95
    assert all(x >= 0.6 for x in s.scores(["你 们 客 服 就 是 个 白 痴 ， 滚 远 点 。", "SHUT UP YOU I-D-I-O-T, NOBODY WANTS YOU HERE", "shut up you 1d10t, nobody wants you here"]))
    assert s.scores(["", None, "  ", "..."]) == [0, 0, 0, 0]


def test_windows_cover_everything():
    for n in (0, 1, 40, 41, 60, 61, 500):
        inside = {i for a, b in spans(n) for i in range(a, b)}
        assert inside == set(range(n)) and all(b - a <= 40 for a, b in spans(n))
    assert steps(plain("Ａ1 垃 圾")) == steps(plain("a1 垃圾"))


def test_nothing_to_learn_from():
    assert max(Scorer(train([("好", 0.0)] * 5)).scores(["白痴"])) < 0.01
    assert max(Scorer(train([])).scores(["白痴"])) < 0.01


def test_job(spark):
    rows = [(i, t, "s") for i, (t, _) in enumerate(corpus(90))] + [(900, None, "s"), (901, "", "s"), (None, BAD[0], "s"), (902, GOOD[0] * 3000 + BAD[0], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rater string")
    labels = [(i, r, int(y), 0, None) for i, (_, y) in enumerate(corpus(90)) for r in ("r1", "r2")] + [(1, "r1", None, None, None), (None, "r1", 1, 0, 0), (0, "r1", 1, 0, None)]
    rated = ratings(spark.createDataFrame(labels, "doc_id long, rater string, is_abusive int, is_hateful int, is_sexual int"))
    assert rated.count() == 90
    net = fit(docs, "doc_id", "text", rated)
    got = {r.doc_id: r.score for r in score(docs, "doc_id", "text", net).collect()}
    assert len(got) == len(rows) and got[900] == got[901] == 0 and got[902] >= 0.6 and got[None] >= 0.6
    assert score(docs.limit(0), "doc_id", "text", net).count() == 0


def test_every_letter_of_a_long_word_is_read():
    word = "a" * 30 + "bitch"
    assert "".join(steps(plain(word))) == plain(word) and all(len(t) <= LETTERS for t in steps("x" * 1000))


def test_a_kept_network_scores_alike(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus(60))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", int(y), 0, 0) for i, (_, y) in enumerate(corpus(60))], "doc_id long, rater string, is_abusive int, is_hateful int, is_sexual int")
    one, two = (fitted(docs, "doc_id", "text", labels) for _ in range(2))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)
    texts = [t for t, _ in corpus(20, 5)]
    assert Scorer(one).scores(texts) == Scorer(two).scores(texts)
