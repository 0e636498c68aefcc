"""Failures that lie exactly as far apart as a rule says."""

import datetime

import duckdb

from turnstile.plans.queries import ORACLES, QUERIES


def test_sessions_end_at_a_gap_of_six_hours(spark, tmp_path):
    start, gaps = datetime.datetime(2024, 1, 3), [0, 21_599, 21_600, 0, 21_601, 21_600]
    rows, at = [], start
    for i, gap in enumerate(gaps):
        at += datetime.timedelta(seconds=gap)
        rows.append((i, at + datetime.timedelta(milliseconds=100 * i), 7, "error"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["attack_sessions"]).fetchall())
    assert [w[3] for w in want] == [2, 2, 1, 1]
    assert sorted(map(tuple, QUERIES["attack_sessions"](spark, str(tmp_path)).collect())) == want
