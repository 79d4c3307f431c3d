"""The parts chained: landed polls to reports, rows to summaries to archives."""

import json
from datetime import datetime, timedelta

import pytest

from airtrace.plans import lifecycle as L
from airtrace.plans.contact_reports import overall_atc_statistics
from airtrace.plans.flight_reports import latest_flights
from airtrace.session import shared_folder
from airtrace.sources import adhoc, reference
from airtrace.streaming.ingest import Filters, ingested, start_ingest

T0 = datetime(2025, 1, 1, 10)


def poll(minute):
    at = (T0 + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
    pilot = {
        "cid": 1, "callsign": "QFA1", "name": "Kim", "latitude": -33.9, "longitude": 151.2, "altitude": 100, "groundspeed": 200,
        "logon_time": "2025-01-01T09:59:00Z", "last_updated": at,
        "flight_plan": {"aircraft_short": "B738", "departure": "YSSY", "arrival": "YMML", "flight_rules": "I", "deptime": "1000"}}
    radio = lambda who: {"callsign": who, "transceivers": [{"id": 0, "frequency": 118100000, "latDeg": -33.9, "lonDeg": 151.2}]}
    return {
        "poll_time": at, "pilots": [pilot, pilot | {"callsign": "VOZ2", "cid": 2}],
        "controllers": [{"cid": 3, "callsign": "SY_TWR", "frequency": "118.100", "facility": 4, "rating": 3,
                         "logon_time": "2025-01-01T09:30:00Z", "last_updated": at}],
        "transceivers": [radio("QFA1"), radio("SY_TWR")] if minute < 5 else [radio("QFA1")]}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("chain")
    (base / "landing").mkdir()
    for minute in range(8):
        (base / "landing" / f"{minute}.json").write_text(json.dumps(poll(minute)) + "\n")
    for _ in range(2):  # a second run on the same checkpoint finds nothing new
        start_ingest(spark, f"{base}/landing", f"{base}/store", f"{base}/state", Filters(), files_per_batch=3, availableNow=True).awaitTermination()
    return [ingested(spark, f"{base}/store", n) for n in ("flights", "transceivers", "controllers")]


def test_ingested_rows_have_ids_and_feed_reports(spark, store):
    flights, radios, staff = store
    assert flights.count() == 16 and flights.select("id").distinct().count() == 16
    assert radios.count() == radios.select("id").distinct().count() and staff.where("created_at is null").count() == 0
    assert overall_atc_statistics(flights, radios, staff).count() == 1
    assert {r.callsign for r in latest_flights(flights, T0 + timedelta(minutes=8)).collect()} == {"QFA1", "VOZ2"}


def test_rows_become_summaries_and_archives(spark, store):
    flights, radios, staff = store
    none = spark.createDataFrame([], "id bigint, callsign string, departure string, arrival string, cid int, deptime string, completion_time timestamp")
    stays = spark.createDataFrame([("QFA1", "ARL", T0, T0 + timedelta(minutes=4), 240)],
                                  "callsign string, sector_name string, entry_timestamp timestamp, exit_timestamp timestamp, duration_seconds int")
    run = L.process_flights(flights, radios, staff, stays, none, T0 + timedelta(hours=30))
    rows = {r.callsign: r for r in run.summaries.collect()}
    assert set(rows) == {"QFA1", "VOZ2"} and rows["QFA1"].primary_enroute_sector == "ARL" and rows["QFA1"].id != rows["VOZ2"].id
    archived = {(r.callsign, r.time_online_minutes, r.primary_enroute_sector) for r in run.archived.collect()}
    assert archived == {("QFA1", 7, "ARL"), ("VOZ2", 7, None)} and run.remaining.count() == 0
    again = L.process_flights(run.remaining, radios, staff, stays, run.summaries, T0 + timedelta(hours=30))
    assert again.summaries.count() == 0
    assert L.sync_archive_columns(run.archived, run.summaries).count() == 16


def test_commands_are_refused_when_parsed(spark):
    for sql in ("set spark.sql.ansi.enabled=false", "add jar x", "merge into a using b on a.x = b.x when matched then delete", "refresh table a"):
        with pytest.raises(ValueError):
            adhoc.adhoc_sql(spark, sql)
    assert adhoc.adhoc_sql(spark, "with a as (select id from {t}) select * from a order by id", t=spark.range(3)).count() == 3


def test_folder_for_intermediate_files():
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        shared_folder(Cluster(), "x")


def test_type_list(spark, tmp_path):
    (tmp_path / "types.txt").write_text("# fighters\nF18\n\nC130\nF18\n")
    assert reference.src_aircraft_types(spark, str(tmp_path / "types.txt")) == ["C130", "F18"]
