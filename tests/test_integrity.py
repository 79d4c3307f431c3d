"""Joins of the integrity checks whose rows are many more than their input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airtrace.plans import integrity

T0 = datetime(2025, 1, 1, 10, 0)


def archive(spark, sessions):
    rows = [(i, c, i % 7, 1 + i % 11, None if m is None else T0 + timedelta(minutes=m)) for i, (c, m) in enumerate(sessions)]
    return spark.createDataFrame(rows, "id bigint, callsign string, cid int, rating int, logon_time timestamp")


def summaries(spark, sessions):
    rows = [(c, None if m is None else T0 + timedelta(minutes=m), i % 400, i % 50) for i, (c, m) in enumerate(sessions)]
    return spark.createDataFrame(
        rows, "callsign string, session_start_time timestamp, session_duration_minutes int, total_aircraft_handled int"
    )


ODD = [("A_TWR", None), (None, 0), ("ONLY", 3), ("A_TWR", 1), ("A_TWR", 1), ("", 0)]


@pytest.mark.parametrize("most", [10**9, 3300, 200, 1])
def test_archive_vs_summary_is_the_left_join(spark, most):
    # ten keys of 66 * 50 rows, some of few, nulls on both sides, rows that come twice
    hot = [(f"HOT{k}", 0) for k in range(10)]
    old = hot * 60 + [(f"C{i % 5}", i % 3) for i in range(40)] + ODD
    new = hot * 50 + [(f"C{i % 4}", i % 2) for i in range(30)] + ODD
    a = archive(spark, old)
    a, s = a.unionAll(a.where("floor(id / 10) % 10 = 0")), summaries(spark, new)
    got = integrity.archive_vs_summary(a, s, most)
    by_key = {}
    for r in s.collect():
        by_key.setdefault((r[0], r[1]), []).append((r[1], r[2], r[3]))
    want = [
        tuple(r) + x
        for r in a.collect()
        if r.logon_time is not None
        for x in (by_key.get((r.callsign, r.logon_time), []) if r.callsign is not None else []) or [(None, None, None)]
    ]
    order = lambda rows: sorted(map(str, rows))
    assert order(map(tuple, got.collect())) == order(want)
    assert got.columns == [*a.columns, "session_start_time", "session_duration_minutes", "total_aircraft_handled"]


def test_a_key_of_many_rows_is_dealt_over_tasks(spark):
    a, s = archive(spark, [("HOT", 0)] * 400), summaries(spark, [("HOT", 0)] * 100)
    got = integrity.archive_vs_summary(a, s, 2000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 20_000
