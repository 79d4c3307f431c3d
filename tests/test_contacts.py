import os

import pytest
from pyspark.sql import functions as F

from airtrace.operators import contacts as C
from airtrace.plans import contact_reports as R
from airtrace.registry.derived import Derived

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def t(spark):
    return Derived(spark, FOLDER)


@pytest.mark.parametrize("report", [R.overall_atc_statistics, R.atc_by_position, R.pct_time_by_aircraft])
def test_cut_buckets_change_nothing(t, report):
    plain = report(t.flights, t.transceivers, t.controllers, pieces=1)
    cut = report(t.flights, t.transceivers, t.controllers, pieces=3)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_cut_buckets_in_flight_matching(t):
    plain = C.match_flight_atc(t.flights, t.transceivers, t.controllers, window="flight", pieces=1)
    cut = C.match_flight_atc(t.flights, t.transceivers, t.controllers, window="flight", pieces=2)
    rows = sorted(map(str, plain.collect()))
    assert rows and sorted(map(str, cut.collect())) == rows


def test_one_hot_frequency(spark):
    """A third and more of all rows on one frequency in one minute."""
    hot = spark.range(3000).select(
        F.col("id"), F.concat(F.lit("F"), (F.col("id") % 700).cast("string")).alias("callsign"),
        F.when(F.col("id") % 10 == 0, "atc").otherwise("flight").alias("entity_type"),
        F.when(F.col("id") % 3 < 2, 118_000_000).otherwise(119_000_000 + F.col("id") * 25_000).alias("frequency"),
        F.lit(-33.0).alias("position_lat"), F.lit(151.0).alias("position_lon"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 60).alias("timestamp"),
    )
    staff = hot.where("entity_type = 'atc'").select("id", "callsign", F.lit(4).alias("facility"), F.col("timestamp").alias("last_updated"))
    radios = hot
    n_flight = hot.where("entity_type = 'flight' and frequency = 118000000").count()
    n_atc = hot.where("entity_type = 'atc' and frequency = 118000000").count()
    pairs = C.report_match_all(radios, staff, pieces=4)
    assert pairs.count() == n_flight * n_atc
    assert C.matched_flight_times(radios, staff, pieces=4).count() == n_flight


def test_plans_stay_equi_joins(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (R.overall_atc_statistics, R.atc_by_rank):
            df = report(t.flights, t.transceivers, t.controllers)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, tmp_path, t):
    path = str(tmp_path / "flights")
    t.flights.write.parquet(path)
    from airtrace.plans.flight_reports import latest_flights

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # a plan names all filters
    try:
        plan = latest_flights(spark.read.parquet(path), "2024-01-01 00:15:00")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(last_updated" in plan and "LessThanOrEqual(last_updated" in plan
    assert "flight_rules" not in plan.split("ReadSchema")[1]


def test_silent_parties_do_not_match(spark):
    """Before the log-on alone is not enough, for the aircraft or the controller."""
    def at(second):
        return f"timestamp_seconds({1_700_000_000 + second})"

    flights = spark.sql(
        f"select 1L id, 'A' callsign, 'X' departure, 'Y' arrival, {at(0)} logon_time, {at(60)} last_updated "
        f"union all select 2L, 'B', 'X', 'Y', {at(0)}, {at(60)}"
    )
    def radio(i, callsign, kind, second):
        return f"select {i}L id, '{callsign}' callsign, '{kind}' entity_type, 118000000L frequency, 0D position_lat, 0D position_lon, {at(second)} timestamp"

    radios = spark.sql(" union all ".join([
        radio(1, "A", "flight", -60), radio(2, "A", "flight", 60),
        radio(3, "B", "flight", -60),                                  # never on the radio after log-on
        radio(4, "S_TWR", "atc", -100), radio(5, "S_TWR", "atc", 30),
        radio(6, "Q_TWR", "atc", -90),                                 # silent after log-on
        radio(7, "G_TWR", "atc", 30),                                  # gone before log-on
    ]))
    staff = spark.sql(
        f"select 'S_TWR' callsign, 4 facility, {at(30)} last_updated union all select 'Q_TWR', 4, {at(30)} "
        f"union all select 'G_TWR', 4, {at(-500)} union all select 'S_TWR', 0, {at(900)}"
    )
    found = C.match_flight_atc(flights, radios, staff).select("flight_callsign", "atc_callsign").distinct().collect()
    assert [tuple(r) for r in found] == [("A", "S_TWR")]
