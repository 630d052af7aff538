import math
import random

from pyspark.sql import functions as F

from heronry.operators import evaluate, lifecycle, retrieval, sessions, structure, telemetry
from heronry.sources.files import scan
from heronry.streaming import windows

REQ = "request_id long, ts double, endpoint string, duration_ms double, status string, agent string, tokens int, session_id string"


def requests(spark):
    rows = [(i, 1000.0 + i, "/chat", float(i) if i % 7 else None, "error" if i % 5 == 0 else "success", ["a", "b", "", None][i % 4], i, f"s{i % 3}" if i % 6 else "") for i in range(40)]
    return spark.createDataFrame(rows + rows[:3] + [(99, None, None, math.nan, None, None, None, None)], REQ), rows


def test_percentiles_at_rank(spark):
    df, rows = requests(spark)
    got = {r.who: r for r in telemetry.at_rank(telemetry.records(df), ["who"], telemetry.measured(), {"p50": 0.5, "p90": 0.9}).collect()}
    for who in ("a", "b", "/chat"):
        v = sorted(r[3] for r in rows if (r[5] or r[2]) == who and r[3])
        assert (got[who].n, got[who].p50, got[who].p90) == (len(v), v[len(v) // 2], v[int(0.9 * len(v))])


def test_snapshot_and_sessions(spark):
    df, rows = requests(spark)
    s = telemetry.snapshot(telemetry.records(df)).first()
    assert s.total_requests == 41 and s.active_sessions == 3 and s.qps == round(40 / 39, 2)
    per = {r.session_id: r for r in telemetry.sessions(telemetry.records(df), as_of=1400.0).collect()}
    assert per["s1"].dead and per["s1"].requests == sum(r[7] == "s1" for r in rows)
    assert telemetry.snapshot(telemetry.records(df.limit(0))).first().total_requests == 0


def test_dense_search_against_brute_force(spark):
    rnd = random.Random(1)
    vecs = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense_search(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding", 4).collect()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    for q in (0, 20, 40):
        best = sorted(((-round(sum(a * b for a, b in zip(unit(vecs[q][1]), unit(v))), 6), i) for i, v in vecs if v and any(v)))[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in best]
    assert {q for q, _ in got} == {0, 20, 40}


def test_fusion_is_symmetric_and_filter_keeps_some(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    one, two = (sorted(map(tuple, retrieval.fuse(x, y, 3).select("id", "score", "rank").collect())) for x, y in ((a, b), (b, a)))
    assert one == two and one[1][0] == 11 and one[1][2] == 1
    hits = spark.createDataFrame([(1, 1, 0.2, 1), (1, 2, 0.1, 2), (2, 1, 0.35, 1), (2, 2, 0.34, 2)], "query_id int, id int, score double, rank int")
    assert sorted((r.query_id, r.id) for r in retrieval.keep_good(hits).collect()) == [(1, 1), (2, 1)]


def test_windows_of_children(spark):
    df = spark.createDataFrame([("d", f"c{j}", j, "x") for j in range(11)], "doc_id string, child_id string, chunk_index int, content string")
    got = {r.win: (r["first"], r["last"]) for r in structure.parent_windows(structure.places(df)).collect()}
    assert got == {0: (0, 5), 1: (3, 8), 2: (6, 10), 3: (9, 10)}


def test_sections_and_paths(spark):
    text = "lost\n# A\nx\n## B。tail\n# 目录\n### C\ny\n# D\n### E"
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, None), (4, "")], "id int, text string")
    found = structure.sections(df, ["id"], "text")
    got = {(r.id, r.section): r.path for r in structure.section_paths(found, ["id"]).collect()}
    assert got[1, 1] == "A" and got[1, 2] == "A · B" and got[1, 3] == "A · B · C" and got[1, 5] == "D · E" and got[2, 0] == "正文"
    # what stands behind the title on its line opens the section
    assert {(r.id, r.section): r.content for r in found.collect()}[1, 2] == "tail\n目录".replace("目录", "# 目录")


def packed(text, size, least_unit=20, least_tail=100):
    """The packing by hand, sentence by sentence."""
    chunks, now = [], ""
    for para in text.split("\n\n"):
        sentences, word = [], ""
        for ch in para + "\n":
            word += "" if ch == "\n" else ch
            if ch in "。！？；!?;\n":
                sentences += [word.strip()] if word.strip() else []
                word = ""
        units, short = [], ""
        for s in sentences:
            short = (short + " " + s).strip()
            if len(short) >= least_unit:
                units.append(short)
                short = ""
        if short:
            units = [*units[:-1], f"{units[-1]} {short}"] if units else [short]
        for u in units:
            if now and len(now) + len(u) > size:
                chunks.append(now)
                now = u
            else:
                now = f"{now} {u}" if now else u
        if len(now) >= least_tail and units:
            chunks.append(now)
            now = ""
    return chunks + [now] * bool(now)


def test_packing_against_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("甲乙丙丁。！\n ab") for _ in range(rnd.randrange(1500))) for _ in range(40)]
    texts += ["一二三四五。" * 200, "short", "。", "x" * 900 + "。y。", "\n\n\n\n", "a。\n\nb。\n\n" + "长" * 120, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size in (60, 200):
        for r in df.select("text", structure.pack(F.col("text"), size).alias("c")).collect():
            assert r.c == packed(r.text, size)
            squeeze = lambda s: "".join(s.split())
            assert squeeze("".join(r.c)) == squeeze(r.text)
    out = structure.chunks(df.withColumn("title", F.lit("T")), ["id"], "title", "text").where("id = 41").collect()
    assert [(r.chunk_index, r.content) for r in out] == [(0, "[章节: T]\n\nshort")]


def test_repeats_and_memory(spark):
    said = ["hi", "hi ", "hi", "hi", "yo", "hi", "", None]
    df = spark.createDataFrame([(i, "s", m, i) for i, m in enumerate(said)] + [(0, "s", "hi", 0)], "message_id int, session_id string, message string, sent_at int")
    assert [r.message_id for r in sessions.repeats(df).where("is_spam").orderBy("message_id").collect()] == [2, 3]
    assert sessions.memory(df, 3).count() == 3
    assert sessions.compressed(df, 1, 4, 1, 2).count() == 3


def test_clock_relations(spark):
    sch = "key string, node string, ticks long"
    a = spark.createDataFrame([("e", "x", 1), ("a", "x", 2), ("b", "x", 1), ("c", "x", 2)], sch)
    b = spark.createDataFrame([("e", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", "y", 1), ("c", "y", 1)], sch)
    assert {r.key: r.relation for r in sessions.relation(a, b).collect()} == {"e": "equal", "a": "a_after_b", "b": "b_after_a", "c": "concurrent"}


def test_conflicts_and_upsert(spark):
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "doc_id string, file_hash string")
    old = spark.createDataFrame([("a", 3, "h1"), ("b", 1, "h0")], "doc_id string, doc_version int, file_hash string")
    got = {p: {r.doc_id: (r.action, r.version) for r in lifecycle.conflict_actions(new, old, p).collect()} for p in ("overwrite", "reject", "keep_both", "?")}
    assert got["overwrite"] == {"a": ("skip", 3), "b": ("overwrite", 2), "c": ("create", 1)} == got["?"]
    assert got["reject"]["b"] == ("reject", 1) and got["keep_both"]["b"] == ("keep_both", 2)
    merged = lifecycle.upsert(old, spark.createDataFrame([("a", 4, "h9")], old.schema), ["doc_id"])
    assert sorted((r.doc_id, r.doc_version) for r in merged.collect()) == [("a", 4), ("b", 1)]


def test_rule_metrics(spark):
    df = spark.createDataFrame([("退货要几天", "退货要三天 完成", "退货要三天", "三天"), ("x", None, None, None)], "question string, contexts string, answer string, reference string")
    rows = evaluate.rule_metrics(df).collect()
    assert rows[0].faithfulness == 1.0 and rows[0].contextualrecall == 1.0 and rows[1].score == 0.5


def test_breaker_steps():
    state, seen = ("closed", 0, 0.0), []
    for now, good in [(0, False), (1, False), (2, False), (10, True), (31.9, True), (32, True), (33, True), (34, False)]:
        *state, allowed = windows.step(*state, now, good, 3, 30.0, 2)
        seen.append((state[0], allowed))
    assert seen == [("closed", True)] * 2 + [("open", True), ("open", False), ("open", False), ("trial", True), ("closed", True), ("closed", True)]


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    rows = [(i, i * 10, ["a", "b"][i % 2], 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, s int, kind string, value double").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = windows.event_windows(windows.source(spark, str(tmp_path / "in"), df.schema), "ts", "kind", "value")
    windows.run_once(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.started.timestamp(), r.kind): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(n == 3 for n in got.values()) and len(got) >= 16


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# 标题", encoding="utf-8")
    (tmp_path / "sub" / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "c.zip").write_bytes(b"PK")
    got = {r.file_name: (r.status, r.text) for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("success", "# 标题"), "b.PDF": ("needs_parser", None), "c.zip": ("unsupported", None)}
