"""Queries that took only a prefix of their input."""

import datetime

from epochlake.plans import registry


def test_event_windows_of_a_hot_user(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, 1 if k < 505 else 2, start + datetime.timedelta(seconds=k), float(k)) for k in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.win): (r.n, r.mean) for r in registry.queries()["w2_event_windows"](spark, str(tmp_path)).collect()}
    assert {w: v for (u, w), v in got.items() if u == 1} == {w: (20, w * 10 + 9.5) for w in range(49)}


def test_ovr_logistic_has_all_components(spark):
    rows = registry.queries()["m13_ovr_logistic"](spark, "/root/testdata/sf0.001").collect()
    assert {r.feature for r in rows} == {f"x{k + 1}" for k in range(64)} and len(rows) == 640
