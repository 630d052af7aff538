import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p2_found", "q_sparse_topk", "q_headings", "q_sessions", "r_nation_revenue"])
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA)
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(got.columns)
    norm = lambda v: round(v, 4) if isinstance(v, float) else str(v)
    a = sorted(str([norm(r[c]) for c in cols]) for r in got.collect())
    b = sorted(str([norm(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())
    assert a == b


def test_registry_needs_no_session():
    import subprocess
    import sys

    here = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, check=True).stdout.split()[-1]) > 20
