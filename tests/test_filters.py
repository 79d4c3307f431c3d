from pyspark.sql import functions as F

from airtrace.operators import filters as X

AUSTRALIA = [(-45.0, 110.0), (-45.0, 155.0), (-10.0, 155.0), (-10.0, 110.0)]


def test_boundary_keeps_unknown_positions(spark):
    rows = [("SYD", -33.9, 151.2), ("LHR", 51.5, -0.5), ("NONE", None, None), ("HALF", -33.0, None)]
    flights = spark.createDataFrame(rows, "callsign string, latitude double, longitude double")
    assert {r.callsign for r in X.filter_boundary_flights(flights, AUSTRALIA).collect()} == {"SYD", "NONE", "HALF"}
    radios = flights.toDF("callsign", "position_lat", "position_lon")
    assert {r.callsign for r in X.filter_boundary_transceivers(radios, AUSTRALIA).collect()} == {"SYD", "NONE", "HALF"}


def test_boundary_from_edges(spark, tmp_path):
    from airtrace.sources.reference import src_polygon

    geo = tmp_path / "a.json"
    geo.write_text('{"type": "Polygon", "coordinates": [[[110,-45],[155,-45],[155,-10],[110,-10],[110,-45]]]}')
    plain = tmp_path / "b.json"
    plain.write_text('{"coordinates": [[-45,110],[-45,155],[-10,155],[-10,110]]}')
    rows = [("SYD", -33.9, 151.2), ("LHR", 51.5, -0.5), ("EDGE", -45.0, 120.0), ("NONE", None, None)]
    flights = spark.createDataFrame(rows, "callsign string, latitude double, longitude double")
    for path in (geo, plain):
        edges = src_polygon(spark, str(path))
        assert edges.count() == 4
        assert {r.callsign for r in X.filter_boundary_flights(flights, edges).collect()} == {"SYD", "NONE"}


def test_boundary_on_snapshot_arrays(spark):
    docs = spark.sql("select array(named_struct('callsign','A','latitude',-30D,'longitude',140D), named_struct('callsign','B','latitude',50D,'longitude',0D)) as pilots")
    assert [p.callsign for p in X.filter_boundary_snapshot(docs, AUSTRALIA).first().pilots] == ["A"]


def test_frequency_filter(spark):
    hz = [122_800_000, 122_800_499, 122_799_600, 122_800_400, 122_799_999, 118_000_000, 0, None, -5, 1_000_000_000_000, 121_500_000]
    radios = spark.createDataFrame([(i, h) for i, h in enumerate(hz)], "id int, frequency bigint")
    kept = {r.id for r in X.filter_frequency(radios, ["122.800"]).collect()}
    assert kept == {5, 6, 7, 10}
    assert X.filter_frequency(radios, []).count() == len(hz)
    assert X.filter_frequency(radios, [99.9]).count() == len(hz)  # outside the band: ignored


def test_allow_list(spark):
    controllers = spark.createDataFrame([("SY_TWR",), ("XX_OBS",), ("",), (None,)], "callsign string")
    allow = spark.createDataFrame([("SY_TWR",), ("SY_TWR",), ("ML_APP",)], "callsign string")
    assert [r.callsign for r in X.filter_controller_allowlist(controllers, allow).collect()] == ["SY_TWR"]
    assert X.filter_controller_allowlist(controllers, allow.limit(0)).count() == 4
    report = {r.action: r.n_rows for r in X.cleanup_report(controllers, allow).collect()}
    assert report == {"keep": 1, "remove": 3}


def test_callsign_pattern(spark):
    rows = spark.createDataFrame([("SY_ATIS",), ("sy_atis",), ("SY_TWR",), ("",), (None,)], "callsign string")
    assert [r.callsign for r in X.filter_callsign_pattern(rows).collect()] == ["sy_atis", "SY_TWR", "", None]
    assert X.filter_callsign_pattern(rows, []).count() == 5


def test_incomplete_plan(spark):
    rows = spark.createDataFrame([("A", "B"), ("", "B"), ("A", ""), (None, "B"), ("A", None)], "departure string, arrival string")
    assert X.filter_incomplete_plan(rows).count() == 1


def test_counts_and_atis(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    got = X.filter_counts(rows, F.col("n") > 1, F.col("n") == 3).first()
    assert tuple(got) == (3, 2, 1, 1)
    lines = spark.createDataFrame([(["a", "b"],), (None,)], "l array<string>")
    assert [r[0] for r in lines.select(X.join_atis(F.col("l"))).collect()] == ["a b", None]
