import pytest
from pyspark.sql import functions as F

from airtrace.functions import aircraft, callsign, geo, values
from airtrace.functions.exact import percent, rounded_ratio, whole_minutes

UNIT_SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]


def column(spark, schema, rows, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize("banded", [True, False])
def test_point_in_polygon_edges_are_outside(spark, banded):
    lat, lon = F.col("lat"), F.col("lon")
    if banded:
        test = geo.point_in_polygon(lat, lon, UNIT_SQUARE)
    else:
        test = geo.point_in_edges(lat, lon, geo.edges_literal(UNIT_SQUARE))
    rows = [(0.5, 0.5), (0.0, 0.5), (0.5, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.0), (1.5, 0.5), (0.5, -0.1), (91.0, 0.5), (None, 0.5)]
    got = column(spark, "lat double, lon double", rows, test)
    assert got == [True] + [False] * 9


def test_polygon_concave(spark):
    ring = [(0, 0), (0, 4), (4, 4), (4, 0), (2, 2)]
    got = column(spark, "lat double, lon double", [(2.0, 1.0), (2.0, 3.0), (1.0, 0.6), (2.0, 2.0)],
                 geo.point_in_polygon(F.col("lat"), F.col("lon"), ring))
    assert got == [False, True, False, False]


def test_bands_equal_all_edges(spark):
    """A jagged star: the banded form equals the test over every edge."""
    import math
    import random

    rng = random.Random(5)
    ring = [(r * math.cos(2 * math.pi * i / 90), r * math.sin(2 * math.pi * i / 90)) for i in range(90) for r in [rng.uniform(3, 10)]]
    points = [(rng.uniform(-11, 11), rng.uniform(-11, 11)) for _ in range(800)] + [ring[7], (ring[3][0], 0.0)]
    lat, lon = F.col("lat"), F.col("lon")
    schema = "lat double, lon double"
    banded = column(spark, schema, points, geo.point_in_polygon(lat, lon, ring))
    plain = column(spark, schema, points, geo.point_in_edges(lat, lon, geo.edges_literal(ring)))
    assert banded == plain and 100 < sum(banded) < 700 and banded[800] is False


def test_distance(spark):
    d = geo.nm_distance(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    rows = [(-33.8688, 151.2093, -37.8136, 144.9631), (0.0, 0.0, 0.0, 1.0), (10.0, 10.0, 10.0, 10.0)]
    got = column(spark, "a double, b double, c double, d double", rows, d)
    assert got[0] == pytest.approx(385.2, abs=0.5)
    assert got[1] == pytest.approx(60.04, abs=0.01)
    assert got[2] == pytest.approx(0.0, abs=1e-3)
    near = geo.nm_within(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 300)
    assert column(spark, "a double, b double, c double, d double", rows + [(None, 1.0, 1.0, 1.0)], near) == [False, True, True, False]


def test_coordinates(spark):
    texts = ["-343848.000", "+1494851.000", "+1800000.000", "149.8142", "-23.426358", " +100000.0 ",
             "", "abc", "12345.0", "-343848", "12345678.0", None, "1.2.3", "--10.0", "34a848.0"]
    got = column(spark, "t string", [(t,) for t in texts], geo.parse_coordinate(F.col("t")))
    assert got[:6] == pytest.approx([-34.646667, 149.814167, 180.0, 149.8142, -23.426358, 10.0], abs=1e-5)
    assert got[6:] == [None] * 9


def test_callsign_rules(spark):
    names = ["SY_TWR", "cb_gnd", "ML_DEL", "BN_APP", "BN_DEP", "ML-ASP_CTR", "AU_FSS", "X", "", "SY_ATIS"]
    rows = [(n,) for n in names]
    kind = callsign.controller_type(F.col("c"))
    assert column(spark, "c string", rows, kind) == [
        "Tower", "Ground", "Ground", "Approach", "Approach", "Center", "FSS", "Ground", "Ground", "Ground"]
    assert column(spark, "c string", rows, callsign.proximity_nm(kind)) == [15, 15, 15, 60, 60, 400, 1000, 15, 15, 15]
    assert column(spark, "c string", [("FSS_CTR_GND",)], callsign.position_type(F.col("c"))) == ["FSS"]
    assert column(spark, "c string", [("FSS_CTR_GND",)], callsign.position_type(F.col("c"), callsign.SESSION_ORDER)) == ["GND"]
    assert column(spark, "c string", [("sy_twr",), ("SY_APP",)], callsign.contact_type(F.col("c"))) == ["TWR", "OTHER"]


def test_khz_half_to_even(spark):
    hz = [122_800_500, 122_801_500, 122_800_999, 122_800_499, 0]
    assert column(spark, "h bigint", [(h,) for h in hz], values.khz(F.col("h"))) == [122_800, 122_802, 122_801, 122_800, 0]


def test_parse_utc(spark):
    texts = ["2025-01-01T10:00:00.123456Z", "2025-01-01T10:00:00Z", "2025-01-01T12:00:00+02:00", "nonsense", None, ""]
    got = column(spark, "t string", [(t,) for t in texts], F.date_format(values.parse_utc(F.col("t")), "HH:mm:ss.SSS"))
    assert got == ["10:00:00.000"] * 3 + [None] * 3


def test_rounding(spark):
    rows = [(1, 8), (1, 3), (2, 3), (0, 5), (5, 0), (12345, 100000)]
    assert column(spark, "a bigint, b bigint", rows, percent(F.col("a"), F.col("b"))) == [12.5, 33.33, 66.67, 0.0, None, 12.35]
    assert column(spark, "a bigint, b bigint", [(1, 4)], rounded_ratio(F.col("a"), F.col("b"), 1)) == [0.3]


def test_whole_minutes(spark):
    got = spark.sql("select timestamp'2024-01-01 00:00:30' a, timestamp'2024-01-01 00:02:29' b").select(
        whole_minutes(F.col("a"), F.col("b"))).first()[0]
    assert got == 1


def test_aircraft_categories(spark):
    kinds = ["A20N", "A359", "A332", "B738", "B77W", "CRJ9", "DH8D", "C172", "PC12", "F18", "BE58", "H60", "B350", "172", "ZZZ", "A21N", "DC3"]
    got = column(spark, "k string", [(k,) for k in kinds], aircraft.aircraft_category(F.col("k")))
    assert got == ["Airbus A320 Family", "Airbus A350 Family", "Airbus A330 Family", "Boeing 737 Family", "Boeing 777 Family",
                   "Regional Jets", "De Havilland Canada", "Business Jets", "Business Jets", "Military Aircraft",
                   "Beechcraft Aircraft", "Military Aircraft", "Beechcraft King Air", "Cessna 172", "Other Aircraft",
                   "Airbus A220 Family", "Business Jets"]


def test_object_keys_of_text_and_map(spark):
    text = spark.createDataFrame([('{"A":{},"B":{}}',), ("{}",), (None,)], "c string")
    assert [r[0] for r in text.select(values.object_keys(text, "c")).collect()] == [["A", "B"], [], None]
    maps = spark.createDataFrame([({"A": 1},)], "c map<string,int>")
    assert maps.select(values.object_keys(maps, "c")).first()[0] == ["A"]
