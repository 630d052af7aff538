import random

from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm.splitting import cuts, split_oversized, split_text

PIECE_TEXT = st.text(alphabet="ab 。\n，.é́\U00020b6d🚚‍\r!", max_size=600)


@settings(max_examples=150, deadline=None)
@given(PIECE_TEXT, st.integers(5, 80), st.integers(0, 40))
def test_round_trip_and_limits(text, most, lap):
    spans = split_text(text, most, lap)
    lap = min(lap, most - 1)
    assert "".join(text[a + o : b] for a, b, o in spans) == text
    for i, (a, b, o) in enumerate(spans):
        assert b - a <= most and o == (lap if i else 0)
        assert i == 0 or text[a : a + o] == text[spans[i - 1][1] - o : spans[i - 1][1]]


def test_cuts_at_sentences_and_edits_stay_local():
    rnd = random.Random(1)
    text = "".join("".join(rnd.choice("甲乙丙丁戊己庚辛") for _ in range(rnd.randrange(8, 30))) + "。" for _ in range(400))
    ends = cuts(text, 300, 40)
    assert all(text[e - 1] == "。" for e in ends)
    changed = text[:1000] + "新加的一句话。" + text[1000:]
    moved = {e - 7 for e in cuts(changed, 300, 40)}
    same = [e for e in ends if e in moved]
    assert len(same) >= 0.8 * len([e for e in ends if e > 1000])


def test_items(spark):
    long = "句子很长。" * 300
    rows = [("child", "a", long, 1, 9), ("child", "a", long, 1, 9), ("child", "b", "short", 1, 9), ("child", "c", None, 1, 9), ("child", None, long, 1, 9), ("other", "d", long, 1, 9), ("child", "e", "x" * 500, 1, 9), ("child", "f", "", 1, 9)]
    items = spark.createDataFrame(rows, "item_kind string, item_id string, text string, piece int, max_chars int")
    limits = spark.createDataFrame([("child", 120, 20), ("parent", None, 5), ("odd", 0, 1)], "item_kind string, max_chars int, overlap_chars int")
    got = split_oversized(items, limits).collect()
    assert {r.item_id for r in got} == {"a", None, "e"} and all(len(r.piece) <= 120 for r in got)
    one = sorted((r for r in got if r.item_id == "a"), key=lambda r: r.piece_no)
    assert "".join(r.piece[r.overlap :] for r in one) == long and [r.piece_no for r in one] == list(range(one[0].n_pieces))
    assert split_oversized(items.limit(0), limits).count() == 0


def test_overlaps_over_half_the_limit():
    text = "甲乙丙丁戊。" * 300
    for most, lap in ((120, 20), (120, 90), (120, 119), (10, 9)):
        parts = split_text(text, most, lap)
        assert all(b - a <= most for a, b, _ in parts) and {o for _, _, o in parts[1:]} == {lap} and parts[0][2] == 0
        assert "".join(text[a + o : b] for a, b, o in parts) == text
    assert {o for _, _, o in split_text(text, 10, 50)[1:]} == {9}
