import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from airtrace.operators.sectors import sector_stays, stale_sector_close
from airtrace.registry.streaming_queries import stream_settings
from airtrace.sources.reference import rectangle_sectors
from airtrace.streaming import sector_stream, windows

T0 = datetime(2024, 1, 1, 6, 0)
US = 1_000_000
SCHEMA = "id bigint, callsign string, latitude double, longitude double, altitude int, groundspeed int, last_updated timestamp"


def test_timer_ends_the_stay_of_a_silent_aircraft(spark, tmp_path):
    """A is seen for two minutes and never again; B goes on in later batches."""
    source = str(tmp_path / "in")
    batches = [
        [(i, "A", 5.0, 2.0, 100 + i, 200, T0 + timedelta(minutes=i)) for i in range(3)]
        + [(10, "B", 5.0, 2.0, 100, 200, T0)],
        [(20, "B", 5.0, 2.0, 100, 200, T0 + timedelta(minutes=60))],
        [(21, "B", 5.0, 2.0, 100, 200, T0 + timedelta(minutes=61))],
    ]
    rows = spark.createDataFrame([(1, "R", 0.0, 10.0, 0.0, 10.0)], "ord int, sector_name string, lon_min double, lon_max double, lat_min double, lat_max double")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with stream_settings(spark, **{"spark.sql.streaming.stateStore.providerClass": sector_stream.PROVIDER, "spark.sql.shuffle.partitions": "2"}):
        for batch in batches:
            # one run per batch, on the same checkpoint
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            flights = spark.readStream.schema(SCHEMA).parquet(source)
            stays = sector_stream.sector_stays_stream(flights, rectangle_sectors(rows))
            windows.start_append(stays, out, state, availableNow=True).awaitTermination()
    got = {(r.callsign, r.entry_timestamp, r.duration_seconds, r.exit_altitude)
           for r in spark.read.schema(sector_stream.STAY).parquet(out).collect()}
    assert got == {("A", T0, 120, 102), ("B", T0, 0, 100)}


def test_late_rows_over_many_batches_equal_the_batch_operator(spark, tmp_path):
    """Rows come up to two minutes late, in twelve runs; a last row far ahead lets all of them pass."""
    rng = random.Random(5)
    rows, n = [], 0
    for who in "ABC":
        for minute in range(60):
            n += 1
            if rng.random() < 0.85:  # left out rows make gaps
                rows.append((n, who, 5.0, rng.choice([2.0, 2.0, 2.0, 12.0, 30.0]), n, rng.choice([200, 200, 30]), T0 + timedelta(minutes=minute)))
    last = (999, "Z", 5.0, 30.0, 0, 0, T0 + timedelta(hours=3))
    sectors = rectangle_sectors(spark.createDataFrame(
        [(1, "R", 0.0, 10.0, 0.0, 10.0), (2, "S", 10.0, 20.0, 0.0, 10.0)],
        "ord int, sector_name string, lon_min double, lon_max double, lat_min double, lat_max double"))
    # a batch holds six minutes; rows of its last two minutes may come in the next one instead
    batches = [[] for _ in range(11)] + [[last]]
    for r in rows:
        minute = (r[6] - T0).seconds // 60
        batches[minute // 6 + (minute % 6 >= 5 and rng.random() < 0.6)].append(r)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    with stream_settings(spark, **{"spark.sql.streaming.stateStore.providerClass": sector_stream.PROVIDER, "spark.sql.shuffle.partitions": "2"}):
        for batch in filter(None, batches):
            rng.shuffle(batch)
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            flights = spark.readStream.schema(SCHEMA).parquet(source)
            windows.start_append(sector_stream.sector_stays_stream(flights, sectors, "6 minutes"), out, state, availableNow=True).awaitTermination()
    # the watermark ends six minutes before the last row
    want = sector_stays(spark.createDataFrame(rows + [last], SCHEMA), sectors, as_of=F.lit(last[6] - timedelta(minutes=6)))
    got = spark.read.schema(sector_stream.STAY).parquet(out)
    assert all_columns(got) == all_columns(want.where("callsign <> 'Z'")) and got.count() > 20


def all_columns(stays):
    assert sorted(stays.columns) == sorted(sector_stream.STAY_COLUMNS)
    return sorted((tuple(r) for r in stays.select(*sector_stream.STAY_COLUMNS).collect()), key=str)


def test_open_stays_and_a_start_from_batch_stays(spark, tmp_path):
    """The first half in one batch run, the second half as a stream of ten batches that goes on from its open stays."""
    rng = random.Random(11)
    rows, n = [], 0
    for who in "ABCDE":
        for minute in range(120):
            n += 1
            if rng.random() < 0.9 and not (who == "E" and minute > 50):  # E falls silent before the stream begins
                lat = None if rng.random() < 0.1 else 5.0
                rows.append((n, who, lat, rng.choice([2.0] * 6 + [12.0]), n, rng.choice([200] * 8 + [30, None]), T0 + timedelta(minutes=minute)))
    tick = (9999, "Z", None, None, None, None, T0 + timedelta(minutes=122))
    sectors = rectangle_sectors(spark.createDataFrame(
        [(1, "R", 0.0, 10.0, 0.0, 10.0), (2, "S", 10.0, 20.0, 0.0, 10.0)],
        "ord int, sector_name string, lon_min double, lon_max double, lat_min double, lat_max double"))
    early, late = ([r for r in rows if (r[6] < T0 + timedelta(minutes=60)) == first] for first in (True, False))
    before = spark.createDataFrame(early, SCHEMA)
    first = sector_stays(before, sectors)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    with stream_settings(spark, **{"spark.sql.streaming.stateStore.providerClass": sector_stream.PROVIDER, "spark.sql.shuffle.partitions": "2"}):
        for i in range(10):
            part = [r for r in late if (r[6] - T0).seconds // 360 - 10 == i] + ([tick] if i == 9 else [])
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            flights = spark.readStream.schema(SCHEMA).parquet(source)
            stays = sector_stream.sector_stays_stream(flights, sectors, "2 minutes", sector_stream.state_of(first, before))
            windows.start_append(stays, out, state, availableNow=True).awaitTermination()
        held = sector_stream.open_stays(spark, state)
        found = first.where("exit_timestamp is not null").unionByName(spark.read.schema(sector_stream.STAY).parquet(out)).unionByName(held)
        whole = spark.createDataFrame(rows, SCHEMA)
        want = sector_stays(whole, sectors, as_of=F.lit(T0 + timedelta(minutes=120)))
        assert all_columns(found) == all_columns(want) and held.count() > 0
        later = F.lit(T0 + timedelta(hours=9))
        assert all_columns(stale_sector_close(found, whole, later)) == all_columns(stale_sector_close(want, whole, later))


class Cell:
    """A state variable of any kind that counts the rows written to it."""

    written = 0

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, Cell.written = value, Cell.written + 1

    def put(self, values):
        self.value, Cell.written = values, Cell.written + len(values)

    def clear(self):
        self.value = None


class Handle:
    def getValueState(self, name, schema):
        return Cell()

    getListState = getValueState

    def listTimers(self):
        return []

    def registerTimer(self, ms):
        pass


class Watermark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def test_waiting_rows_do_not_each_take_a_row_of_state():
    """Two batches of 3,000 rows with nulls and a late row; a batch writes two rows of state, however many rows wait."""
    stays = sector_stream.SectorStays()
    stays.init(Handle())
    Cell.written = 0
    rows = [(i * 60 * US, i if i % 9 else None, None if i % 5 == 1 else "AB"[i // 1000 % 2], None if i % 7 == 0 else 5.0, 2.0, None if i % 11 == 0 else i)
            for i in range(6_000)]
    rows[2_999], rows[3_000] = rows[3_000], rows[2_999]  # one comes a batch late
    found, passed = [], 0
    for part in (rows[:3_000], rows[3_000:]):
        frame = pd.DataFrame(part, columns=["us", "id", "seen", "latitude", "longitude", "altitude"])
        frame["callsign"] = "T"
        found += list(stays.handleInputRows(("T",), iter([frame[:700], frame[700:]]), Watermark(passed)))
        passed = max(r[0] for r in part) - 120 * US
    found += list(stays.handleExpiredTimer(("T",), Watermark(6_100 * 60 * US), None))
    got = pd.concat(found)
    assert Cell.written <= 4
    assert list(got["sector_name"]) == ["A", "B"] * 3
    assert list(got["entry_timestamp"]) == [pd.Timestamp(k * 1000 * 60, unit="s") for k in range(6)]
    assert list(got["duration_seconds"]) == [999 * 60] * 6
    assert got["entry_lat"].isna().tolist() == [k * 1000 % 7 == 0 for k in range(6)]
