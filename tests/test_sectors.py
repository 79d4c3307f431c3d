import random
from collections import namedtuple
from datetime import datetime, timedelta

import pytest

from airtrace.functions.values import at
from airtrace.operators import sectors as S
from airtrace.sources.reference import rectangle_sectors
from airtrace.streaming.sector_stream import advance

T0 = datetime(2024, 1, 1, 5, 50)
RECTANGLES = [(1, "ARL", "A", 0.0, 10.0, 0.0, 10.0), (2, "WOL", "A", 5.0, 20.0, 0.0, 10.0), (3, "KEN", "B", 20.0, 30.0, 0.0, 10.0)]
SCHEMA = "id bigint, callsign string, latitude double, longitude double, altitude int, groundspeed int, last_updated timestamp"


@pytest.fixture(scope="module")
def sectors(spark):
    rows = spark.createDataFrame(RECTANGLES, "ord int, sector_name string, main_sector string, lon_min double, lon_max double, lat_min double, lat_max double")
    return rectangle_sectors(rows)


def place(lat, lon):
    for _, name, _, lon0, lon1, lat0, lat1 in RECTANGLES:
        if lon0 < lon < lon1 and lat0 < lat < lat1:
            return name
    return None


def event_loop(rows):
    """The rules applied row by row: closed stays and those still open."""
    stays, states = [], {}
    for id_, cs, lat, lon, alt, speed, t in sorted(rows, key=lambda r: (r[6], r[0])):
        state = states.get(cs)
        if state and (t - state["last"][0]).total_seconds() > 300:
            if state["sector"]:
                stays.append((cs, state["sector"], state["entry"][0], state["last"][0], state["entry"][1:], state["last"][1:]))
            state = None
        before = state["sector"] if state else None
        if lat is None or lon is None or speed is None:
            now = before
        else:
            now = place(lat, lon) if speed >= 60 else None
        here = (t, lat, lon, alt)
        if state is None or now != before:
            if before:
                stays.append((cs, before, state["entry"][0], state["last"][0], state["entry"][1:], state["last"][1:]))
            state = {"sector": now, "entry": here}
        state["last"] = here
        states[cs] = state
    opened = [(cs, s["sector"], s["entry"][0], None, s["entry"][1:], (None,) * 3) for cs, s in states.items() if s["sector"]]
    return stays, opened


def random_rows(seed, callsigns=6, polls=160):
    rng, rows, id_ = random.Random(seed), [], 0
    for c in range(callsigns):
        t, lat, lon = T0, 5.0, rng.uniform(0, 30)
        for _ in range(polls):
            t += timedelta(seconds=rng.choice([60, 60, 60, 60, 120, 300, 301, 360, 4000]) if rng.random() < 0.15 else 60)
            lon = min(31.0, max(-1.0, lon + rng.uniform(-3, 3)))
            speed = rng.choice([None, 0, 25, 59, 60, 61, 200, 450, 450, 450, None])
            position = (None, None) if rng.random() < 0.05 else (lat, lon)
            id_ += 1
            rows.append((id_, f"C{c}", *position, rng.randrange(0, 40000), speed, t))
    return rows


def as_tuples(df):
    return sorted(
        ((r.callsign, r.sector_name, r.entry_timestamp, r.exit_timestamp, (r.entry_lat, r.entry_lon, r.entry_altitude),
          (r.exit_lat, r.exit_lon, r.exit_altitude)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,chunk_hours", [(1, 1), (2, 1), (3, 2), (4, 6), (5, 1)])
def test_stays_equal_the_event_loop(spark, sectors, seed, chunk_hours):
    rows = random_rows(seed)
    closed, opened = event_loop(rows)
    got = S.sector_stays(spark.createDataFrame(rows, SCHEMA), sectors, chunk_hours=chunk_hours)
    assert as_tuples(got) == sorted(closed + opened, key=repr)


def test_sparse_unknown_chunks(spark, sectors):
    """Whole chunks without speed carry the state of the chunk before."""
    rows = [(i, "A", 5.0, 2.0, 100, 300 if i == 0 else None, T0 + timedelta(minutes=4 * i)) for i in range(80)]
    rows.append((99, "A", 5.0, 2.0, 100, 10, rows[-1][6] + timedelta(minutes=1)))
    closed, opened = event_loop(rows)
    got = S.sector_stays(spark.createDataFrame(rows, SCHEMA), sectors, chunk_hours=1)
    assert as_tuples(got) == sorted(closed + opened, key=repr)
    assert len(closed) == 1


def test_plan_has_two_shuffles_of_rows(spark, sectors):
    plan = S.sector_stays(spark.createDataFrame(random_rows(1), SCHEMA), sectors)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(callsign") == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_speed_sequence(spark, sectors):
    """120 in, 45 out, 60 in, 25 out, 25 out, 80 in, unknown keeps."""
    speeds = [120, 45, 60, 25, 25, 80, None]
    rows = [(i, "T", 5.0, 2.0, 3000, s, T0 + timedelta(minutes=i)) for i, s in enumerate(speeds)]
    rows += [(50 + i, "N", 5.0, 2.0, 3000, None, T0 + timedelta(minutes=i)) for i in range(3)]
    got = [(r.callsign, r.entry_timestamp.minute, r.duration_seconds, r.exit_timestamp is None)
           for r in S.sector_stays(spark.createDataFrame(rows, SCHEMA), sectors).collect()]
    assert sorted(got) == [("T", 50, 0, False), ("T", 52, 0, False), ("T", 55, 0, True)]


def test_as_of_closes_old_stays(spark, sectors):
    rows = [(i, "T", 5.0, 2.0, 3000, 200, T0 + timedelta(minutes=i)) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    late = S.sector_stays(df, sectors, as_of=at("2024-01-01 06:30:00")).first()
    assert late.exit_timestamp == T0 + timedelta(minutes=2) and late.duration_seconds == 120
    assert S.sector_stays(df, sectors, as_of=at("2024-01-01 05:55:00")).first().exit_timestamp is None


def test_stale_close(spark, sectors):
    rows = [(i, "T", 5.0, 2.0, 3000 + i, 200, T0 + timedelta(minutes=i)) for i in range(11)]
    flights = spark.createDataFrame(rows, SCHEMA)
    stays = S.sector_stays(flights, sectors)
    closed = S.stale_sector_close(stays, flights, at("2024-01-01 06:30:00")).first()
    assert (closed.duration_seconds, closed.exit_altitude) == (600, 3010)
    fresh = S.stale_sector_close(stays, flights, at("2024-01-01 06:05:00")).first()
    assert fresh.exit_timestamp is None
    count = S.stale_sector_count(stays, flights, at("2024-01-01 06:05:00")).first()
    assert (count.open_sectors_count, count.potentially_stale_sectors_count) == (1, 10)


Row = namedtuple("Row", "us latitude longitude altitude seen")


@pytest.mark.parametrize("seed", [11, 12])
def test_stream_state_equals_the_event_loop(seed):
    rows = random_rows(seed, callsigns=2)
    closed, _ = event_loop(rows)
    got = []
    for cs in ("C0", "C1"):
        state = None
        mine = sorted((r for r in rows if r[1] == cs), key=lambda r: (r[6], r[0]))
        for i in range(0, len(mine), 7):  # micro-batches
            batch = [
                Row(int(r[6].timestamp() * 1e6), r[2], r[3], r[4],
                    None if None in (r[2], r[3], r[5]) else ((place(r[2], r[3]) or "") if r[5] >= 60 else ""))
                for r in mine[i:i + 7]
            ]
            state, out = advance(cs, state, batch)
            got += out
    assert sorted((g[0], g[1], g[4]) for g in got) == sorted((c[0], c[1], int((c[3] - c[2]).total_seconds())) for c in closed)


def test_first_sector_and_main_sector(spark, sectors):
    points = spark.createDataFrame([(1, 5.0, 7.0), (2, 5.0, 12.0), (3, 5.0, 5.0), (4, 5.0, 20.0), (5, None, 1.0), (6, 5.0, 40.0)],
                                   "id int, latitude double, longitude double")
    got = {r.id: r.sector_name for r in S.sector_for_point(points, sectors).collect()}
    assert got == {1: "ARL", 2: "WOL", 3: "ARL", 4: None, 5: None, 6: None}
    hierarchy = spark.createDataFrame([("A", "ARL"), ("A", "WOL"), ("B", "KEN"), ("C", "WOL")], "main_sector string, sector_name string")
    mains = sorted((r.id, r.main_sector) for r in S.main_sector_for_point(points, sectors.drop("main_sector"), hierarchy).collect() if r.main_sector)
    assert mains == [(1, "A"), (1, "C"), (2, "A"), (2, "C"), (3, "A")]


def test_breakdown_and_primary(spark):
    t = lambda m: T0 + timedelta(minutes=m)
    stays = spark.createDataFrame(
        [("A", "X", t(0), t(5), 300), ("A", "Y", t(5), t(10), 300), ("A", "Z", t(10), t(10), 59), ("A", "X", t(200), t(210), 600),
         ("A", "W", t(11), None, 0)],
        "callsign string, sector_name string, entry_timestamp timestamp, exit_timestamp timestamp, duration_seconds int")
    flights = spark.createDataFrame([("A", t(0), t(60))], "callsign string, logon_time timestamp, completion_time timestamp")
    parts = S.sector_breakdown(stays, flights)
    assert sorted((r.sector_name, r.minutes) for r in parts.collect()) == [("X", 5), ("Y", 5)]
    best = S.primary_sector(parts).first()
    assert (best.primary_sector, best.total_sectors, best.total_minutes, best.sector_breakdown) == ("X", 2, 10, {"X": 5, "Y": 5})
