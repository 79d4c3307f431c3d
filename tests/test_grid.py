"""Cells against distances, the pairs they save, and bounds that reach the scans."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airtrace.functions.geo import nm_within
from airtrace.operators import contacts as C
from airtrace.operators.bandjoin import within_span
from airtrace.operators.grid import AROUND, place_cell, with_reach_cells
from airtrace.registry.derived import Derived
from airtrace.session import sortable_times

FOLDER = "/root/testdata/sf0.001"
T0 = datetime(2025, 1, 1)


def miles(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 3440.065 * math.acos(max(-1, min(1, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d))))


@pytest.mark.parametrize("limits", [(0, 15, 60), (15, 400, 1000), (300, 5000)])
def test_places_within_reach_share_one_cell(spark, limits):
    deal = random.Random(sum(limits))
    stations = []
    for i in range(160):
        lat = deal.choice([deal.uniform(-90, 90), deal.choice([-90, 90, 89.99, -89.5, 0, 60]), deal.uniform(85, 90), deal.randrange(-8, 9) * 10])
        lon = deal.choice([deal.uniform(-180, 180), 180, -180, 179.9999, deal.uniform(179, 181), deal.randrange(-18, 19) * 10])
        stations.append((i, float(lat), float(lon), float(deal.choice(limits))))
    places = []
    for i, lat, lon, limit in stations:  # about as far as the station reaches
        for _ in range(8):
            away, turn = limit / 60.04 * deal.choice([0, 0.5, 0.999, 1.001, 1.5]), deal.uniform(0, 6.3)
            places.append((len(places), lat + away * math.cos(turn), lon + away * math.sin(turn) / max(math.cos(math.radians(lat)), 1e-6)))
    places += [(5000, 95.0, 10.0), (5001, -100.0, 20.0), (5002, 10.0, 541.0), (5003, None, 1.0), (5004, 1.0, None)]
    p = spark.createDataFrame(places, "p int, lat double, lon double")
    s = spark.createDataFrame(stations, "s int, slat double, slon double, reach double")
    near = nm_within(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"), F.col("reach"))
    want = {(r.p, r.s) for r in p.crossJoin(s).where(near).select("p", "s").collect()}
    cells = p.withColumn("cell", place_cell(F.col("lat"), F.col("lon")))
    met = [(r.p, r.s) for r in cells.join(with_reach_cells(s, "slat", "slon", "reach", "cell"), "cell").select("p", "s").collect()]
    assert len(met) == len(set(met)) and want <= set(met) and len(want) > 300
    if max(limits) <= 60:  # and few others
        assert len(met) < 0.2 * len(places) * len(stations)


def test_cells_of_unknown_and_extreme_reaches(spark):
    rows = [(1, 0.0, 0.0, 1e9), (2, None, 0.0, 15.0), (3, 0.0, 0.0, None), (4, 0.0, 0.0, -1.0), (5, 89.0, 0.0, 15.0), (6, 5.0, 5.0, 15.0), (7, 1.0, 1.0, 1000.0)]
    s = spark.createDataFrame(rows, "i int, a double, b double, r double")
    got = {r.i: r["count"] for r in with_reach_cells(s, "a", "b", "r", "cell").groupBy("i").count().collect()}
    assert got[1] == 19 * AROUND and got[5] == 4 and got[6] == 1 and 16 <= got[7] <= 25 and set(got) == {1, 5, 6, 7}


# ---------------------------------------------------------------- pairs and scans


@pytest.fixture(scope="module")
def t(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return Derived(spark, FOLDER)


def test_fewer_pairs_before_the_exact_test(t, monkeypatch):
    """Pairs that agree in frequency and time, with and without the cells."""
    counted = {}
    whole = C.band_join

    def pairs(cells):
        def join(left, right, bands, on=(), condition=None, pieces=1):
            if ("_cell", "_reach") not in on:
                return whole(left, right, bands, on, condition=condition, pieces=pieces)
            if not cells:
                left, on = left.drop("_cell"), []
                right = right.drop("_reach").distinct()
            counted[cells] = whole(left, right, bands, on).count()
            return whole(left, right, bands, on, condition=condition)
        return join

    rows = {}
    for cells in (False, True):
        monkeypatch.setattr(C, "band_join", pairs(cells))
        rows[cells] = C.match_flight_atc(t.flights, t.transceivers, t.controllers, window="flight").count()
    assert rows[True] == rows[False] > 0
    assert counted[True] < 0.7 * counted[False]


def scanned(df):
    """Rows that each scan of a finished plan has given out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    out = []

    def visit(node):
        for i in range(node.children().size()):
            visit(node.children().apply(i))
        name = node.nodeName()
        if "QueryStage" in name or "AdaptiveSparkPlan" in name:
            visit(node.plan() if "QueryStage" in name else node.finalPhysicalPlan())
        if name.startswith("Scan parquet"):
            out.append(node.metrics().apply("numOutputRows").value())

    visit(plan)
    return out


def test_bounds_reach_the_scan(spark, tmp_path):
    rows = spark.range(40_000).select("id", F.timestamp_seconds(F.lit(1_735_689_600) + F.col("id") * 60).alias("at"))
    with sortable_times(spark):
        rows.coalesce(1).write.option("parquet.block.size", 20_000).option("parquet.page.size", 2000).parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    spans = spark.createDataFrame([(T0 + timedelta(hours=30), T0 + timedelta(hours=31)), (T0 + timedelta(hours=40), T0 + timedelta(hours=41))], "a timestamp, b timestamp")
    out = within_span(stored, "at", spans, "a", "b", 60)
    assert out.count() == 11 * 60 + 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: [isnotnull(at" in plan and "ubquery" in plan.split("DataFilters")[1]
    assert 663 <= scanned(out)[0] < 10_000
    assert within_span(stored, "at", spans, "a", None, 0).count() == 40_000 - 30 * 60
    assert within_span(stored, "at", spans.limit(0), "a", "b").count() == 0


def test_a_run_reads_the_radios_of_its_flights_only(spark, t, tmp_path):
    for name, time in (("transceivers", "timestamp"), ("flights", "last_updated"), ("controllers", "last_updated")):
        getattr(t, name).sort(time).coalesce(1).write.parquet(str(tmp_path / name))
    radios, flights, staff = (spark.read.parquet(str(tmp_path / n)) for n in ("transceivers", "flights", "controllers"))
    keys = C.flight_keys(flights).where("callsign in ('FLT1', 'FLT3')")
    for window in ("logon", "flight"):
        out = C.match_flight_atc(flights, radios, staff, window=window, keys=keys)
        plan = out._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
        for mark, time, least in (("entity_type#", "timestamp", 3), ("facility#", "last_updated", 1)):
            own = [s.split("DataFilters: ")[1] for s in scans if mark in s.split("Batched")[0]]
            assert len(own) >= least and all(f"isnotnull({time}#" in s.split("Format")[0] for s in own), (window, mark)
        assert plan.count("ubquery") > 5
        want = C.match_flight_atc(flights, radios, staff, window=window).where("flight_callsign in ('FLT1', 'FLT3')")
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
