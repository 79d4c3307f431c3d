import json

import pytest

from airtrace import schemas
from airtrace.sources import adhoc, reference, snapshots
from airtrace.streaming import ingest

POLL = {
    "poll_time": "2025-01-01T10:00:30Z",
    "pilots": [
        {"cid": 1, "callsign": "QFA1", "name": "Kim", "latitude": -33.9, "longitude": 151.2, "altitude": 100, "groundspeed": 200,
         "logon_time": "2025-01-01T09:00:00.75Z", "last_updated": "2025-01-01T10:00:00.999Z",
         "flight_plan": {"aircraft_short": "B738", "departure": "YSSY", "arrival": "YMML", "altitude": "35000"}},
        {"cid": 2, "callsign": "BAW1", "latitude": 51.0, "longitude": 0.0, "flight_plan": None, "last_updated": "bad"},
    ],
    "controllers": [{"cid": 3, "callsign": "SY_TWR", "frequency": "118.100", "facility": 4, "rating": 3, "text_atis": ["a", "b"]},
                    {"callsign": "XX_OBS", "facility": 0}],
    "transceivers": [
        {"callsign": "QFA1", "transceivers": [{"id": 1, "frequency": 118100000, "latDeg": -33.9, "lonDeg": 151.2}, {"id": 2, "frequency": 122800000}]},
        {"callsign": "SY_TWR", "transceivers": [{"frequency": 118100000}]},
        {"callsign": "NOBODY", "transceivers": []},
        {"callsign": "OTHER", "transceivers": [{"id": 5, "frequency": 121500000}]},
    ],
}


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(POLL) + "\n")
    return str(folder)


def test_parse(spark, landing):
    polls = snapshots.src_snapshots(spark, landing, schemas.POLL)
    flights = {r.callsign: r for r in snapshots.parse_flights(polls).collect()}
    assert flights["QFA1"].aircraft_type == "B738" and flights["QFA1"].planned_altitude == "35000"
    assert str(flights["QFA1"].last_updated) == "2025-01-01 10:00:00"
    assert (flights["BAW1"].departure, flights["BAW1"].last_updated, flights["BAW1"].altitude) == ("", None, 0)
    controllers = {r.callsign: r for r in snapshots.parse_controllers(polls).collect()}
    assert (controllers["SY_TWR"].text_atis, controllers["XX_OBS"].name, controllers["XX_OBS"].text_atis) == ("a b", "", None)
    radios = snapshots.parse_transceivers(polls)
    linked = sorted((r.callsign, r.transceiver_id, r.entity_type) for r in
                    snapshots.link_transceivers(radios, snapshots.parse_flights(polls), snapshots.parse_controllers(polls)).collect())
    assert linked == [("OTHER", 5, "flight"), ("QFA1", 1, "flight"), ("QFA1", 2, "flight"), ("SY_TWR", 0, "atc")]


def test_ingest_stream_survives_a_second_run(spark, landing, tmp_path):
    ring = [(-45.0, 110.0), (-45.0, 155.0), (-10.0, 155.0), (-10.0, 110.0)]
    allow = spark.createDataFrame([("SY_TWR",)], "callsign string")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        ingest.start_ingest(spark, landing, out, state, ingest.Filters(ring, allow, ["122.800"]), availableNow=True).awaitTermination()
    assert [r.callsign for r in ingest.ingested(spark, out, "flights").collect()] == ["QFA1"]
    assert [r.callsign for r in ingest.ingested(spark, out, "controllers").collect()] == ["SY_TWR"]
    radios = sorted((r.callsign, r.frequency, str(r.timestamp)) for r in ingest.ingested(spark, out, "transceivers").collect())
    assert radios == [("OTHER", 121500000, "2025-01-01 10:00:30"), ("QFA1", 118100000, "2025-01-01 10:00:30"), ("SY_TWR", 118100000, "2025-01-01 10:00:30")]


def test_sectors_file(spark, tmp_path):
    square = [[[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]]
    features = [
        {"properties": {"name": "ARL", "callsign": "ML-ARL_CTR"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"name": "MULTI"}, "geometry": {"type": "MultiPolygon", "coordinates": [square]}},
        {"properties": {}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"name": "SHORT"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}},
    ]
    path = tmp_path / "s.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = reference.src_sectors(spark, str(path)).collect()
    assert [(r.ord, r.sector_name, r.callsign, r.frequency, len(r.edges)) for r in rows] == [(0, "ARL", "ML-ARL_CTR", "N/A", 4)]


def test_hierarchy_and_callsigns(spark, tmp_path):
    h = tmp_path / "h.txt"
    h.write_text("ARL:OCN, CNK\n# note\n\nWOL: GTH\n")
    assert [(r.main_sector, r.sector_name) for r in reference.src_sector_hierarchy(spark, str(h)).collect()] == [("ARL", "OCN"), ("ARL", "CNK"), ("WOL", "GTH")]
    c = tmp_path / "c.txt"
    c.write_text("# list\nSY_TWR\n\n  ML_APP \n")
    assert [r.callsign for r in reference.src_valid_callsigns(spark, str(c)).collect()] == ["SY_TWR", "ML_APP"]


@pytest.mark.parametrize("sql", ["drop table x", "select 1; DELETE from x", "select updated_at from x", "", "   "])
def test_adhoc_refuses(spark, sql):
    with pytest.raises(ValueError):
        adhoc.adhoc_sql(spark, sql)


@pytest.mark.parametrize("limit", [0, -1, 10001])
def test_adhoc_limits(spark, limit):
    with pytest.raises(ValueError):
        adhoc.adhoc_sql(spark, "select 1", limit)


def test_adhoc_and_page(spark):
    df = spark.range(10)
    assert adhoc.adhoc_sql(spark, "select * from {t} where id > 2", 3, t=df).count() == 3
    assert [r.id for r in adhoc.page(df, ["id"], 3, 4).collect()] == [4, 5, 6]


def test_sink_append(spark, tmp_path):
    df = spark.sql("select id, timestamp_seconds(id * 40000) as at from range(10)")
    for _ in range(2):
        snapshots.sink_append(df, str(tmp_path / "t"), "at")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    assert (tmp_path / "t" / "date=1970-01-02").exists()


