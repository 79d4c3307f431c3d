"""Sector stays from a stream of positions, one small state per aircraft."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from airtrace.operators.sectors import ENTRY_KNOTS, GAP_SECONDS, newest_rows, sector_for_point

STATE = (
    "sector string, entry_us bigint, entry_lat double, entry_lon double, entry_altitude int,"
    "last_us bigint, last_lat double, last_lon double, last_altitude int"
)
# The waiting rows of an aircraft in one Arrow stream: a state row for each of them costs far more.
WAITING = "rows binary"
ROWS = pa.schema([
    ("us", pa.int64()), ("id", pa.int64()), ("seen", pa.string()),
    ("latitude", pa.float64()), ("longitude", pa.float64()), ("altitude", pa.int32()),
])
STAY = (
    "callsign string, sector_name string, entry_timestamp timestamp, exit_timestamp timestamp,"
    "duration_seconds int, entry_lat double, entry_lon double, exit_lat double, exit_lon double,"
    "entry_altitude int, exit_altitude int"
)
STAY_COLUMNS = [part.split()[0] for part in STAY.split(",")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


EPOCH = datetime(1970, 1, 1)


def _stay(callsign: str, s: tuple) -> tuple:
    """A closed stay; the exit is the last row seen."""
    entry, last = (EPOCH + timedelta(microseconds=us) for us in (s[1], s[5]))
    return (callsign, s[0], entry, last, (s[5] - s[1]) // 1_000_000, s[2], s[3], s[6], s[7], s[4], s[8])


def _places(frame: pd.DataFrame, at: np.ndarray) -> list[tuple]:
    """Time, position and altitude of some rows; what is absent is None."""
    some = frame.iloc[at]
    columns = [some["us"].tolist(), *[some[c].astype(object).where(some[c].notna(), None) for c in ("latitude", "longitude")]]
    altitudes = [None if pd.isna(v) else int(v) for v in some["altitude"].tolist()]
    return list(zip(*columns, altitudes))


def advance(callsign: str, state: tuple | None, rows: pd.DataFrame | Iterable[tuple]) -> tuple[tuple | None, list[tuple]]:
    """Apply position rows in time order; give the new state and closed stays.

    Rows are taken as columns: only where a stay begins or ends is there a step in Python.
    """
    frame = pd.DataFrame(rows)
    if frame.empty:
        return state, []
    us = frame["us"].to_numpy(dtype=np.int64)
    first_gap = state is None or us[0] - state[5] > GAP_SECONDS * 1_000_000
    gap = np.r_[first_gap, np.diff(us) > GAP_SECONDS * 1_000_000]
    known = frame["seen"].notna().to_numpy()
    # a row that does not tell its sector has that of the row before, and none after a gap
    at = np.maximum.accumulate(np.where(known | gap, np.arange(len(us)), -1))
    told = np.where(known, frame["seen"].to_numpy(dtype=object), "")
    now = np.where(at < 0, "" if state is None else state[0], told[at])
    begins = gap.copy()
    begins[1:] |= now[1:] != now[:-1]
    begins[0] |= not first_gap and now[0] != state[0]
    first = np.flatnonzero(begins)
    last = np.r_[first[1:] - 1, len(us) - 1] if len(first) else first
    stays = [] if state is None else [state]
    if not begins[0]:  # the stay so far goes on
        until = first[0] - 1 if len(first) else len(us) - 1
        stays = [(*state[:5], *_places(frame, np.array([until]))[0])]
    stays += [(sector, *a, *b) for sector, a, b in zip(now[first], _places(frame, first), _places(frame, last))]
    return stays[-1], [_stay(callsign, s) for s in stays[:-1] if s[0]]


def _packed(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, schema=ROWS, preserve_index=False)
    with pa.ipc.new_stream(out, ROWS) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(rows))).read_pandas()


class SectorStays(StatefulProcessor):
    """Per callsign the stay so far and the rows the watermark has not passed yet.

    Rows wait until the watermark passes them and are then applied in time
    order, so rows that come late but in time change nothing. A timer wakes the
    key for its next waiting row, or to end the stay after the gap.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stay", STATE)
        self.waiting = handle.getValueState("waiting", WAITING)

    def _emit(self, closed: list[tuple]) -> Iterator[pd.DataFrame]:
        if closed:
            yield pd.DataFrame(closed, columns=STAY_COLUMNS).astype(
                {"entry_altitude": "Int32", "exit_altitude": "Int32"}
            )

    def _settle(self, callsign: str, waiting: pd.DataFrame, passed_us: int) -> Iterator[pd.DataFrame]:
        """Apply the rows that the watermark has passed and set the next timer."""
        waiting = waiting.sort_values(["us", "id"], kind="stable", na_position="last")
        n = int(np.searchsorted(waiting["us"].to_numpy(dtype=np.int64), passed_us, side="right"))
        due, rest = waiting.iloc[:n], waiting.iloc[n:]
        old = tuple(self.state.get()) if self.state.exists() else None
        new, closed = advance(callsign, old, due)
        gap = GAP_SECONDS * 1_000_000
        if new is not None and passed_us > new[5] + gap:
            if new[0]:
                closed.append(_stay(callsign, new))
            new = None
        self.state.clear() if new is None else self.state.update(new)
        self.waiting.clear() if rest.empty else self.waiting.update((_packed(rest),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not rest.empty:
            self.handle.registerTimer(-(-int(rest["us"].iloc[0]) // 1000))
        elif new is not None:
            self.handle.registerTimer((new[5] + gap) // 1000 + 1)
        yield from self._emit(closed)

    def _rows(self) -> list[pd.DataFrame]:
        return [_unpacked(self.waiting.get()[0])] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one aircraft in one micro-batch: one per poll
        waiting = pd.concat([*self._rows(), *[r[ROWS.names] for r in rows]], ignore_index=True)
        yield from self._settle(key[0], waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._rows() or [ROWS.empty_table().to_pandas()]
        yield from self._settle(key[0], waiting[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        frame = initialState[STATE_COLUMNS].astype(object)
        frame = frame.where(frame.notna(), None)
        state = tuple(next(frame.itertuples(index=False)))
        self.state.update(state)
        # an aircraft that never comes again ends its stay as well
        self.handle.registerTimer((state[5] + GAP_SECONDS * 1_000_000) // 1000 + 1)

    def close(self) -> None:
        pass


STATE_COLUMNS = [part.split()[0] for part in STATE.split(",")]


def state_of(stays: DataFrame, flights: DataFrame) -> DataFrame:
    """The open ones of batch stays as the state of a stream that goes on from there.

    ``flights`` are the rows the stays were made from: a stay goes on from the
    newest row of its aircraft.
    """
    return stays.where(F.col("exit_timestamp").isNull()).join(newest_rows(flights), "callsign").select(
        "callsign", F.col("sector_name").alias("sector"), F.unix_micros(F.col("entry_timestamp").cast("timestamp")).alias("entry_us"),
        "entry_lat", "entry_lon", "entry_altitude", F.unix_micros(F.col("newest").cast("timestamp")).alias("last_us"),
        F.col("new_lat").alias("last_lat"), F.col("new_lon").alias("last_lon"), F.col("new_altitude").alias("last_altitude"),
    )


def open_stays(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stays that are open after the last finished batch, read from the stream's own state.

    They have the columns of closed stays and no exit, as the batch operator
    gives them, so ``stale_sector_close`` and reports run on both together.
    """
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "stay").load()
    v = F.col("value")
    none = {"exit_lat": "double", "exit_lon": "double", "exit_altitude": "int"}
    return held.where(v["sector"] != "").select(
        F.col("key.callsign").alias("callsign"), v["sector"].alias("sector_name"),
        F.timestamp_micros(v["entry_us"]).alias("entry_timestamp"), F.lit(None).cast("timestamp").alias("exit_timestamp"),
        F.lit(0).cast("int").alias("duration_seconds"), v["entry_lat"].alias("entry_lat"), v["entry_lon"].alias("entry_lon"),
        v["entry_altitude"].alias("entry_altitude"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    ).select(*STAY_COLUMNS)


def sector_stays_stream(
    flights: DataFrame, sectors: DataFrame, delay: str = "2 minutes", initial: DataFrame | None = None
) -> DataFrame:
    """Closed stays of a stream of stored positions; ``open_stays`` has the others.

    ``initial`` is the state to start from (``state_of``), used by the first
    batch of a new checkpoint.

    A stay is given out when the aircraft changes sector or slows down, when a
    later row follows a gap, or when the watermark passes the gap. Rows are applied
    once the watermark, ``delay`` behind the newest row, has passed them; rows
    later than that are dropped. The session must use the RocksDB state store (``PROVIDER``).
    """
    placed = sector_for_point(flights.withWatermark("last_updated", delay), sectors)
    unknown = F.col("groundspeed").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull()
    seen = F.when(unknown, None).when(
        F.col("groundspeed") >= ENTRY_KNOTS, F.coalesce("sector_name", F.lit(""))
    ).otherwise("")
    rows = placed.select(
        "callsign", "id", "last_updated", F.unix_micros("last_updated").alias("us"),
        "latitude", "longitude", "altitude", seen.alias("seen"),
    )
    return rows.groupBy("callsign").transformWithStateInPandas(
        SectorStays(), outputStructType=STAY, outputMode="append", timeMode="eventTime",
        initialState=None if initial is None else initial.groupBy("callsign"),
    )
