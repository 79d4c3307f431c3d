"""Reports from stored states and manifests against the same from all rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airtrace.plans import controller_reports as R, lifecycle as L, quality as Q
from airtrace.sources import tables

T0 = datetime(2025, 3, 1)
SUMMARY = "id long, callsign string, controller_callsigns string, completion_time timestamp"


def summaries(spark, first, last):
    rows = []
    for i in range(first, last):
        who = ['{"SY_TWR":{},"ML_CTR":{}}', '{"SY_TWR":{}}', "{}", None][i % 4]
        rows.append((i, f"F{i % 11}", who, T0 + timedelta(hours=5 * i) if i % 13 else None))
    return spark.createDataFrame(rows, SUMMARY)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_weekly_statistics_from_day_states(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    L.load_table(summaries(spark, 0, 120), store, "flight_summaries", "one")
    first = R.refresh_day_states(spark, store)
    assert R.refresh_day_states(spark, store).number == first.number
    L.load_table(summaries(spark, 120, 150), store, "flight_summaries", "two")
    counted = []
    states = R.day_states
    monkeypatch.setattr(R, "day_states", lambda df: counted.append(df) or states(df))
    R.refresh_day_states(spark, store)
    # the new run's days only, the first of which it shares with the run before
    assert {str(r.d) for r in counted[0].select(F.to_date("completion_time").alias("d")).distinct().collect()} == {
        str((T0 + timedelta(hours=5 * i)).date()) for i in range(120, 150) if i % 13}
    whole = summaries(spark, 0, 150)
    for as_of in ("2025-03-08 13:30:00", "2025-03-28 00:00:00", "2025-04-01 12:00:00", "2025-06-01 00:00:00", "2025-01-01 00:00:00"):
        got = rows_of(R.controller_weekly_stored(spark, store, as_of))
        assert got == rows_of(R.controller_weekly_stats(whole, as_of)), as_of
    # the day that the window begins in is the only one read itself
    counted.clear()
    R.controller_weekly_stored(spark, store, "2025-03-28 06:00:00")
    assert {str(r.d) for r in counted[0].select(F.to_date("completion_time").alias("d")).distinct().collect()} <= {"2025-03-21"}
    tables.compact(spark, store, "flight_summaries", "completion_time", grain="month")
    R.refresh_day_states(spark, store)
    assert rows_of(R.controller_weekly_stored(spark, store, "2025-04-01 12:00:00")) == rows_of(R.controller_weekly_stats(whole, "2025-04-01 12:00:00"))


def test_freshness_and_counts_without_a_scan(spark, tmp_path):
    store = str(tmp_path / "s")
    rows = spark.createDataFrame([(i, f"F{i}", T0 + timedelta(minutes=i) if i else None) for i in range(200)], "id long, callsign string, last_updated timestamp")
    L.load_table(rows, store, "flights")
    L.load_table(rows.where("id < 60"), store, "controllers", "a")
    L.load_table(rows.where("id >= 60"), store, "controllers", "b")
    as_of = str(T0 + timedelta(minutes=202))
    fresh = Q.stored_freshness(spark, store, as_of)
    live = {n: (rows if n in ("flights", "controllers") else rows.limit(0), "last_updated") for n in Q.FRESH_SECONDS}
    assert rows_of(fresh) == rows_of(Q.freshness(live, as_of))
    counts = Q.stored_counts(spark, store)
    assert {r.table_name: (r.n_rows, r.present, r.missing_columns) for r in counts.collect()} == {
        **{n: (None, False, ",".join(c for t, c in Q.REQUIRED_COLUMNS if t == n)) for n in Q.REQUIRED_TABLES},
        "flights": (200, True, ""), "controllers": (200, True, "")}
    for df in (fresh, counts):
        assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
    names = {"flights": "last_updated", "controllers": "last_updated"}
    activity = Q.stored_activity(spark, store, names, as_of)
    assert rows_of(activity) == rows_of(Q.recent_activity({n: (rows, t) for n, t in names.items()}, as_of))
    later = str(T0 + timedelta(hours=9))
    activity = Q.stored_activity(spark, store, names, later)
    assert rows_of(activity) == rows_of(Q.recent_activity({n: (rows, t) for n, t in names.items()}, later))
    assert "FileScan" not in activity._jdf.queryExecution().executedPlan().toString()  # nothing of the last hour


@pytest.mark.parametrize("hot", [False, True])
def test_flights_of_controllers_by_bitmaps(spark, hot):
    """Nine tenths of the callsigns on one frequency, which many controllers share."""
    now = T0 + timedelta(hours=2)
    n = 3000
    radios = [(f"F{i}", "flight", 118_000_000 if hot and i % 10 else 118_000_000 + 25_000 * (i % 50)) for i in range(n)] * 2
    radios += [(f"F{i}", "flight", 121_500_000) for i in range(0, n, 7)]
    radios += [(f"S{i % 40}_TWR", "atc", 118_000_000 + 25_000 * (i % 60)) for i in range(400)] + [("S1_TWR", "atc", 121_500_000), ("S1_TWR", "atc", None), (None, "flight", 118_000_000)]
    t = spark.createDataFrame([(*r, T0) for r in radios], "callsign string, entity_type string, frequency long, timestamp timestamp")
    flights = spark.createDataFrame([(f"F{i}", T0 - timedelta(days=9 * (i % 5 == 0))) for i in range(n)] + [(None, T0)], "callsign string, last_updated timestamp")
    staff = spark.createDataFrame([(f"S{i}_TWR", f"N{i % 3}", (2, 5, 3, 1)[i % 4], T0) for i in range(40)] + [("S2_TWR", "Other", 2, T0)], "callsign string, name string, rating int, last_updated timestamp")
    seen = {r.callsign for r in flights.collect() if r.callsign and r.last_updated >= now - timedelta(days=7)}
    by = {}
    for who, kind, hz in radios:
        by.setdefault((kind, who), set()).add(hz)
    want = []
    for r in staff.distinct().collect():
        if r.rating in (2, 3):
            own = by.get(("atc", r.callsign), set()) - {None}
            heard = {who for (kind, who), hz in by.items() if kind == "flight" and who in seen and hz & own}
            if heard:
                want.append((r.callsign, r.name, r.rating, len(heard)))
    want = sorted(want, key=lambda r: (-r[3], r[0], r[1]))[:7]
    got = R.flights_per_controller_radio(staff, flights, t, now, 7)
    assert [tuple(r[c] for c in ("callsign", "name", "rating", "unique_flights_handled")) for r in got.collect()] == want and want[0][3] > 50


def test_newest_rows_are_kept_whatever_the_order(spark, tmp_path):
    import random

    deal = random.Random(4)
    rows = [(i, f"F{deal.randrange(30)}" if i % 50 else None, i % 7, T0 + timedelta(minutes=deal.randrange(9000)) if i % 41 else None) for i in range(600)]
    rows += [(700, "F3", 1, T0 + timedelta(days=9)), (701, "F3", 2, T0 + timedelta(days=9)), (702, "OLD", 0, T0 - timedelta(days=99))]
    schema = "id long, callsign string, altitude int, last_updated timestamp"
    want = {}
    for r in rows:
        if r[1] and r[3] and (r[1] not in want or (r[3], r[0]) > (want[r[1]][3], want[r[1]][0])):
            want[r[1]] = r
    for order in range(3):
        store = str(tmp_path / f"s{order}")
        deal.shuffle(rows)
        for i in range(0, len(rows), 97):
            batch = spark.createDataFrame(rows[i:i + 97], schema)
            for _ in range(1 + (i == 97)):  # one batch twice
                version = tables.upsert_newest(batch, store, "newest", "callsign", "last_updated", f"b{i}")
        got = tables.read(spark, store, "newest")
        assert sorted(map(tuple, got.collect())) == sorted(want.values())
        # a row for an aircraft of today leaves the partition of the one unseen for long as it is
        before = {e for e in version.of("newest") if e.date < "2025-01-01"}
        after = tables.upsert_newest(spark.createDataFrame([(999, "F1", 0, T0 + timedelta(days=30))], schema), store, "newest", "callsign", "last_updated", "last")
        assert before and before <= after.entries
