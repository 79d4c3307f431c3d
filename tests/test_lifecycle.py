from datetime import datetime, timedelta


import pytest

from airtrace.plans import lifecycle as L
from airtrace.plans import integrity

T0 = datetime(2025, 1, 1, 10, 0)
NOW = "2025-01-02 10:00:00"


def t(minutes):
    return T0 + timedelta(minutes=minutes)


FLIGHT = "id bigint, callsign string, departure string, arrival string, cid int, deptime string, aircraft_type string, logon_time timestamp, last_updated timestamp"
SUMMARY = "id bigint, callsign string, departure string, arrival string, cid int, deptime string, logon_time timestamp, completion_time timestamp"


def flights(spark):
    rows = [
        (1, "QFA1", "YSSY", "YMML", 1, "0100", "B738", t(0), t(0)),
        (2, "QFA1", "YSSY", "YMML", 1, "0100", "B738", t(0), t(61)),
        (3, "QFA1", "YSSY", "YMML", 2, "0100", "A320", t(5), t(10)),      # the callsign with another pilot
        (4, "QFA1", "YSSY", "YMML", 1, "0500", "B738", t(300), t(300)),   # same pilot, another plan
        (5, "VOZ2", None, None, 3, "0200", "A320", t(0), t(0)),           # no plan: found, never matched
        (6, "VOZ3", "", "YMML", 4, "0300", "C172", t(0), t(20)),          # empty text does match
        (7, "DONE", "YSSY", "YMML", 5, "0100", "B738", t(0), t(0)),       # summarised already
        (8, "NEW1", "YSSY", "YMML", 6, "0100", "B738", t(1400), t(1430)), # too recent
        (9, "QFA1", "YSSY", "YMML", 1, "0100", "B738", t(0), t(1435)),    # recent row of an old flight
    ]
    return spark.createDataFrame(rows, FLIGHT)


def known(spark):
    return spark.createDataFrame([(1, "DONE", "X", "Y", 9, "0000", t(-900), t(-800))], SUMMARY)


def test_completed_flights(spark):
    got = {(r.callsign, r.departure, r.cid, r.deptime) for r in L.completed_flights(flights(spark), known(spark), NOW).collect()}
    assert got == {("QFA1", "YSSY", 1, "0100"), ("QFA1", "YSSY", 2, "0100"), ("QFA1", "YSSY", 1, "0500"), ("VOZ2", None, 3, "0200"), ("VOZ3", "", 4, "0300")}


def test_archive_and_remaining_share_the_rows(spark):
    f = flights(spark)
    done = L.completed_flights(f, known(spark), NOW)
    assert {r.id for r in L.archive_flights(f, done).collect()} == {1, 2, 3, 4, 6, 9}
    assert {r.id for r in L.remaining_flights(f, done).collect()} == {5, 7, 8}


def test_flight_summaries(spark):
    radios = spark.createDataFrame([], "id bigint, callsign string, frequency bigint, position_lat double, position_lon double, entity_type string, timestamp timestamp")
    controllers = spark.createDataFrame([], "id bigint, callsign string, cid int, facility int, logon_time timestamp, last_updated timestamp")
    stays = spark.createDataFrame([("QFA1", "ARL", t(1), t(11), 600), ("QFA1", "WOL", t(11), t(12), 59)],
                                  "callsign string, sector_name string, entry_timestamp timestamp, exit_timestamp timestamp, duration_seconds int")
    out = L.build_flight_summaries(flights(spark), radios, controllers, stays, known(spark), NOW)
    rows = {(r.callsign, r.cid, r.deptime): r for r in out.collect()}
    assert set(rows) == {("QFA1", 1, "0100"), ("QFA1", 2, "0100"), ("QFA1", 1, "0500"), ("VOZ3", 4, "0300")}
    first = rows[("QFA1", 1, "0100")]
    assert (first.time_online_minutes, first.primary_enroute_sector, first.total_enroute_time_minutes) == (1435, "ARL", 10)
    assert first.controller_callsigns == {} and float(first.controller_time_percentage) == 0
    assert rows[("VOZ3", 4, "0300")].sector_breakdown == {}


CONTROLLER = "id bigint, callsign string, cid int, name string, rating int, facility int, server string, frequency string, logon_time timestamp, last_updated timestamp, created_at timestamp"
DONE = "callsign string, cid int, session_start_time timestamp"


def controllers(spark):
    def row(i, callsign, cid, logon, seen, frequency="118.1"):
        return (i, callsign, cid, "Kim", 3, 4, "AU", frequency, t(logon), t(seen), t(seen))

    return spark.createDataFrame([
        row(1, "SY_TWR", 7, 0, 0), row(2, "SY_TWR", 7, 0, 20, "118.2"),
        row(3, "SY_TWR", 7, 24, 24), row(4, "SY_TWR", 7, 24, 50),     # back after 4 minutes
        row(5, "SY_TWR", 7, 60, 60),                                  # back after 10: not within 5
        row(6, "ML_GND", None, 0, 5),                                 # no cid: finds no rows
        row(7, "BN_APP", 8, 0, 3),                                    # summarised already
        row(8, "CB_DEL", 9, 1420, 1425),                              # still recent
    ], CONTROLLER)


def done(spark):
    return spark.createDataFrame([("BN_APP", 8, t(0))], DONE)


def test_completed_controllers(spark):
    got = {(r.callsign, r.cid, r.logon_time) for r in L.completed_controllers(controllers(spark), done(spark), NOW).collect()}
    assert got == {("SY_TWR", 7, t(0)), ("SY_TWR", 7, t(24)), ("SY_TWR", 7, t(60)), ("ML_GND", None, t(0))}
    nothing = spark.createDataFrame([("ML_GND", None, t(0))], DONE)
    assert "ML_GND" not in {r.callsign for r in L.completed_controllers(controllers(spark), nothing, NOW).collect()}


def test_session_merge_is_one_hop(spark):
    c = controllers(spark)
    merged = L.controller_session_merge(L.completed_controllers(c, done(spark), NOW), c)
    got = {(r.callsign, r.session_start_time): (r.session_end_time, r.session_duration_minutes) for r in merged.collect()}
    assert got == {
        ("SY_TWR", t(0)): (t(50), 50),    # merged with the log-on at 24
        ("SY_TWR", t(24)): (t(50), 26),   # and still a session of its own
        ("SY_TWR", t(60)): (t(61), 1),    # no length becomes a minute
    }


def test_controller_summaries_and_run(spark):
    radios = spark.createDataFrame([
        (1, "SY_TWR", 118_100_000, -33.9, 151.2, "atc", t(10)),
        (2, "QFA1", 118_105_000, -33.95, 151.25, "flight", t(11)),
        (3, "QFA1", 118_100_000, -33.95, 151.25, "flight", t(13)),
        (4, "QFA9", 118_105_001, -33.95, 151.25, "flight", t(11)),    # 5001 Hz away
        (5, "QFA8", 118_100_000, -35.95, 151.25, "flight", t(11)),    # more than 15 miles away
        (6, "QFA7", 118_100_000, -33.95, 151.25, "flight", t(13) + timedelta(seconds=1)),  # 181 s apart
    ], "id bigint, callsign string, frequency bigint, position_lat double, position_lon double, entity_type string, timestamp timestamp")
    c = controllers(spark)
    run = L.process_controllers(c, radios, done(spark), NOW)
    rows = {r.session_start_time: r for r in run.summaries.collect()}
    first = rows[t(0)]
    assert (first.total_aircraft_handled, first.peak_aircraft_count) == (1, 1)
    assert first.frequencies_used == ["118.1", "118.2"]
    detail = first.aircraft_details[0]
    assert (detail.callsign, detail.updates_count, detail.time_on_frequency_minutes, detail.frequency_mhz) == ("QFA1", 2, 2, 118.1)
    assert first.hourly_aircraft_breakdown[10] == 1 and sum(first.hourly_aircraft_breakdown.values()) == 1
    assert rows[t(60)].aircraft_details == [] and rows[t(60)].hourly_aircraft_breakdown == {}
    assert {r.id for r in run.remaining.collect()} == {6, 7, 8}
    assert {r.id for r in run.archived.collect()} == {1, 2, 3, 4, 5}


def test_fill_and_sync_archive(spark):
    summaries = spark.createDataFrame([(1, "A", "X", "Y", 1, "0100", 10, t(0)), (2, "A", "X", "Y", 1, "0100", None, t(5))],
                                      "id bigint, callsign string, departure string, arrival string, cid int, deptime string, time_online_minutes int, completion_time timestamp")
    archive = spark.createDataFrame([(1, "A", "X", "Y", 1, "0100", 7, None), (2, "A", "X", "Y", 2, "0100", None, None), (3, "A", "X", "Y", 1, "0100", 7, t(1))],
                                    "id bigint, callsign string, departure string, arrival string, cid int, deptime string, time_online_minutes int, completion_time timestamp")
    columns = ["time_online_minutes", "completion_time"]
    with pytest.raises(ValueError):
        L.fill_archive_from_summary(archive, summaries)
    filled = {r.id: (r.time_online_minutes, r.completion_time) for r in L.fill_archive_from_summary(archive, summaries, columns).collect()}
    assert filled == {1: (None, t(5)), 2: (None, None), 3: (7, t(1))}
    synced = {r.id: (r.time_online_minutes, r.completion_time) for r in L.sync_archive_columns(archive, summaries, columns).collect()}
    assert synced == {1: (7, t(5)), 2: (10, t(5)), 3: (7, t(1))}


def test_stay_cid_sources(spark):
    stays = spark.createDataFrame([("QFA1", "ARL", t(5)), ("QFA1", "ARL", t(2000)), ("OLD", "ARL", t(0)), ("GONE", "ARL", t(0))],
                                  "callsign string, sector_name string, entry_timestamp timestamp")
    summaries = spark.createDataFrame([(1, "OLD", 77), (2, "QFA1", 5)], "id bigint, callsign string, cid int")
    got = {(r.callsign, r.entry_timestamp): r.cid for r in integrity.backfill_stay_cid(stays, flights(spark), summaries).collect()}
    assert got == {("QFA1", t(5)): 1, ("QFA1", t(2000)): 5, ("OLD", t(0)): 77, ("GONE", t(0)): 999999}


def test_a_run_for_a_past_hour_gives_what_it_gave_then(spark):
    """Rows that came after the time of the run change neither its results nor what it moves."""
    from pyspark.sql import functions as F

    from airtrace.plans.flight_reports import latest_flights

    then = "2025-01-02 10:00:00"
    later = [(50, "QFA1", "YSSY", "YMML", 1, "0100", "B738", t(0), t(1450)), (51, "NEW9", "YSSY", "YMML", 7, "0100", "B738", t(1441), t(1445))]
    before = flights(spark)
    after = before.unionByName(spark.createDataFrame(later, FLIGHT))
    radios = spark.createDataFrame([(i, "QFA1", 118_100_000, -33.9, 151.2, "flight", t(m)) for i, m in ((1, 0), (2, 1445))], "id bigint, callsign string, frequency bigint, position_lat double, position_lon double, entity_type string, timestamp timestamp")
    staff = controllers(spark)
    more_staff = staff.unionByName(spark.createDataFrame([(60, "SY_TWR", 7, "Kim", 3, 4, "AU", "118.9", t(60), t(1446), t(1446))], CONTROLLER))
    stays = spark.createDataFrame([("QFA1", "ARL", t(1), t(11), 600), ("QFA1", "WOL", t(20), t(1442), 85_320)],
                                  "callsign string, sector_name string, entry_timestamp timestamp, exit_timestamp timestamp, duration_seconds int")
    early = stays.where(F.col("exit_timestamp") <= F.lit(t(1440)))
    one = L.process_flights(before, radios.where("id = 1"), staff, early, known(spark), then)
    two = L.process_flights(after, radios, more_staff, stays, known(spark), then)
    for part in ("summaries", "archived"):
        assert sorted(map(str, getattr(one, part).collect())) == sorted(map(str, getattr(two, part).collect()))
    assert {r.id for r in two.remaining.collect()} == {r.id for r in one.remaining.collect()} | {50, 51}
    one = L.process_controllers(staff, radios.where("id = 1"), done(spark), NOW)
    two = L.process_controllers(more_staff, radios, done(spark), NOW)
    for part in ("summaries", "archived"):
        assert sorted(map(str, getattr(one, part).collect())) == sorted(map(str, getattr(two, part).collect()))
    assert {r.id for r in two.remaining.collect()} == {r.id for r in one.remaining.collect()} | {60}
    wide = lambda df: df.selectExpr("*", "0 as latitude", "0 as longitude", "0 as altitude", "0 as heading", "0 as groundspeed", "'' as name")
    assert {r.callsign for r in latest_flights(wide(after), then).collect()} == {r.callsign for r in latest_flights(wide(before), then).collect()}


def test_radio_rows_end_with_a_stored_completion(spark):
    from pyspark.sql import functions as F

    from airtrace.operators import contacts as C

    radios = spark.createDataFrame([(i, who, 118_100_000, 0.0, 0.0, "flight", t(i)) for who in ("A", "B") for i in range(0, 100, 10)],
                                   "id bigint, callsign string, frequency bigint, position_lat double, position_lon double, entity_type string, timestamp timestamp")
    keys = spark.createDataFrame([("A", "X", "Y", t(10)), ("B", "X", "Y", t(10))], "callsign string, departure string, arrival string, logon_time timestamp")
    summaries = spark.createDataFrame([(1, "A", "X", "Y", t(10), t(90)), (2, "A", "X", "Y", t(10), t(40)), (3, "B", "X", "Z", t(10), t(20)), (4, "B", "X", "Y", t(10), None)],
                                      "id bigint, callsign string, departure string, arrival string, logon_time timestamp, completion_time timestamp")
    done_ = C.flight_completion_time(summaries)
    rows = C.flight_radio_rows(keys, radios, F.lit(t(70)), done_)
    assert sorted((r.callsign, r.id) for r in rows.collect()) == [("A", i) for i in (10, 20, 30, 40)] + [("B", i) for i in range(10, 80, 10)]
