import datetime as dt
import random

from heronry.plans.stream_queries import q_stream_windows


def test_windows_do_not_depend_on_the_number_of_files(spark, tmp_path):
    start = dt.datetime(2025, 1, 1)
    rows = [(start + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(240)]
    random.Random(1).shuffle(rows)
    got = []
    for name, files in (("one", 1), ("many", 24)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").repartition(files).write.parquet(f"{path}/events.parquet")
        got.append({(r.started, r.event_type): (r.n, r.total) for r in q_stream_windows(spark, path).collect()})
    end = start + dt.timedelta(minutes=7 * 239) - dt.timedelta(hours=1)
    want: dict = {}
    for ts, kind, value in rows:
        hour = ts.replace(minute=0)
        if hour + dt.timedelta(hours=1) <= end:
            n, total = want.get((hour, kind), (0, 0.0))
            want[hour, kind] = (n + 1, total + value)
    assert got[0] == want and got[1] == want
