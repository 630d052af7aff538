import random
from datetime import datetime, timedelta, timezone

from heronry.operators.references import Reference, orphan_counts, orphans

CHILD = "child_id string, parent_id string, created_at string, reason string, target string"
PARENT = "parent_id string, created_at string"
DEL = "target_table string, target_key string, deleted_at string"


def run(spark, children, parents, deletions):
    c = spark.createDataFrame([(*r, "x", "y") for r in children], CHILD)
    p = spark.createDataFrame(parents, PARENT)
    d = spark.createDataFrame(deletions, DEL)
    ref = Reference("child_chunks", c, "child_id", "parent_id", "parent_chunks", p, "parent_id")
    return orphans([ref], d)


def test_reasons_and_dirty_keys(spark):
    children = [
        ("a", " P1 ", "2026-01-01T00:00:00Z"), ("b", "nope", "2026-01-01"), ("c", "p2", "2026-03-01 00:00:00"), ("d", "p3", "2026-01-01T00:00:00+08:00"),
        ("e", None, "2026-01-01"), ("f", "  ", "2026-01-01"), ("g", "p4", None), ("b", "nope", "2026-01-01"), (None, "nope", None), ("h", "p3", None), ("i", "p5", "2026-01-01T00:00:00Z"),
    ]
    parents = [("p1", "2025-12-31T23:00:00Z"), ("p1", "2025-12-31T23:00:00Z"), ("P2", "2026-01-01"), ("p3", "2026-01-01T00:00:00Z"), ("p4", "2026-02-01"), ("p5", None), ("p5", "2026-09-01"), (None, None)]
    deletions = [("parent_chunks", "p2 ", "2026-02-01T00:00:00Z"), ("parent_chunks", "p2", None), ("parsed_documents", "p1", "2027-01-01"), ("parent_chunks", "p1", "2025-01-01")]
    got = {(r.row_id, r.reason) for r in run(spark, children, parents, deletions).collect()}
    # p3 was created eight hours after d in UTC; g's and h's times are unknown; a target of p5 has no known time
    assert got == {("b", "missing"), (None, "missing"), ("c", "deleted"), ("d", "late")}


def test_empty_tables(spark):
    assert run(spark, [], [], []).count() == 0
    assert run(spark, [("a", "p", None)], [], []).collect()[0].reason == "missing"
    assert orphan_counts(run(spark, [("a", "p", None)], [], [])).collect()[0].period == "unknown"


def test_against_brute_force_with_hot_key(spark):
    rnd = random.Random(5)
    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    at = lambda: None if rnd.random() < 0.1 else (t0 + timedelta(days=rnd.randrange(60))).strftime("%Y-%m-%dT%H:%M:%SZ")
    keys = [f"k{i}" for i in range(25)]
    parents = [(rnd.choice(keys), at()) for _ in range(30)]
    deletions = [("parent_chunks", rnd.choice(keys), at()) for _ in range(12)]
    children = [(f"c{i}", "hot" if i % 3 == 0 else rnd.choice(keys), at()) for i in range(300)]
    want = set()
    for cid, key, created in children:
        dels = [d for _, k, d in deletions if k == key]
        last = max([d for d in dels if d], default=None)
        left = [p for k, p in parents if k == key and not (last and p and p <= last)]
        if not left:
            want.add((cid, "deleted" if dels else "missing"))
        elif created and all(p and p > created for p in left):
            want.add((cid, "late"))
    assert {(r.row_id, r.reason) for r in run(spark, children, parents, deletions).collect()} == want
