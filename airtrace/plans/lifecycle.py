"""From stored rows to summaries, archives and the rows that remain."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import _parse_datatype_string

from airtrace import schemas
from airtrace.functions.exact import whole_minutes
from airtrace.functions.values import ago, at, object_text, stable_id, upto
from airtrace.operators.bandjoin import range_join
from airtrace.operators.contacts import (
    FLIGHT_KEY, aircraft_metrics, atc_contact_metrics, flight_keys, match_controller_flight, match_flight_atc,
)
from airtrace.operators.sectors import primary_sector, sector_breakdown
from airtrace.session import materialise, owned_files
from airtrace.sources import tables

COMPLETED_KEY = ["callsign", "departure", "arrival", "cid", "deptime"]
SESSION = ["callsign", "cid", "logon_time"]

# A flight is complete after 14 hours, a session after 30 minutes,
# and a log-on within 5 minutes of a session's end continues it.
FLIGHT_HOURS = 14
SESSION_MINUTES = 30
RECONNECT_MINUTES = 5


# Columns a flight summary takes from the first row of the flight.
CARRIED = (
    "aircraft_type", "route", "flight_rules", "aircraft_faa", "planned_altitude", "name", "server",
    "pilot_rating", "military_rating", "logon_time",
)


def _need(df: DataFrame, columns, what: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks the columns {absent}")


# --- flights -----------------------------------------------------------------


def completed_flights(flights: DataFrame, summaries: DataFrame, as_of, hours: int = FLIGHT_HOURS) -> DataFrame:
    """Keys with any row older than the limit and a callsign not summarised yet."""
    old = flights.where(F.col("last_updated") < ago(as_of, hours=hours)).select(*COMPLETED_KEY).distinct()
    return old.join(summaries.select("callsign").distinct(), "callsign", "left_anti")


def _of_completed(flights: DataFrame, completed: DataFrame, how: str = "left_semi") -> DataFrame:
    """Detail rows of completed keys; a key with a NULL matches nothing."""
    return flights.join(completed.dropna().select(*COMPLETED_KEY), COMPLETED_KEY, how)


def archive_flights(flights: DataFrame, completed: DataFrame, as_of=None) -> DataFrame:
    """The rows of completed flights, those there were at ``as_of`` if it is given."""
    return _of_completed(flights if as_of is None else upto(flights, "last_updated", as_of), completed)


def remaining_flights(flights: DataFrame, completed: DataFrame, as_of=None) -> DataFrame:
    """All other rows."""
    if as_of is None:
        return _of_completed(flights, completed, "left_anti")
    done = completed.dropna().select(*[F.col(c).alias(f"_{c}") for c in COMPLETED_KEY])
    same = F.coalesce(F.col("last_updated") <= at(as_of), F.lit(False))
    for c in COMPLETED_KEY:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return flights.join(done, same, "left_anti")


def build_flight_summaries(
    flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, stays: DataFrame,
    summaries: DataFrame, as_of, hours: int = FLIGHT_HOURS, poll_secs: int = 60, window: str = "logon",
    completed: DataFrame | None = None,
) -> DataFrame:
    """One summary row per completed flight, all flights in one set of joins.

    A summary has all columns of the stored table; those that the flight rows
    lack are null. ``completed`` are the keys, if they have been found already.
    Rows and stays later than ``as_of`` are left out.

    The row per flight is written to the shared folder once: three later steps
    read it, and the stored positions are not scanned for each of them.
    """
    flights, controllers = (upto(t, "last_updated", as_of) for t in (flights, controllers))
    transceivers = upto(transceivers, "timestamp", as_of)
    stays = stays.where(F.col("exit_timestamp") <= at(as_of))
    if completed is None:
        completed = completed_flights(flights, summaries, as_of, hours)
    detail = _of_completed(flights, completed)
    carried = list(CARRIED)
    kinds = {f.name: f.dataType for f in _parse_datatype_string(schemas.FLIGHT_SUMMARIES)}
    detail = detail.withColumns({c: F.lit(None).cast(kinds[c]) for c in carried if c not in flights.columns})
    # first and last row by partial minima and maxima, not by a sort per flight
    base = detail.groupBy(*COMPLETED_KEY).agg(
        F.min_by(F.struct(*carried), F.struct("last_updated", "id")).alias("_first"),
        F.min("last_updated").alias("_start"),
        F.max("last_updated").alias("completion_time"),
    ).select(*COMPLETED_KEY, "_first.*", "_start", "completion_time")
    base = base.withColumns({
        "time_online_minutes": whole_minutes(F.col("_start"), F.col("completion_time")).cast("int"),
        "aircraft_short": F.col("aircraft_type"),
    }).drop("_start")
    base = materialise(base, "flight-base")
    keys = base.select(*FLIGHT_KEY).dropna().distinct()
    matches = match_flight_atc(flights, transceivers, controllers, window=window, keys=keys)
    contacts = atc_contact_metrics(matches, flights, poll_secs, keys).select(
        *FLIGHT_KEY, "controller_callsigns", "controller_time_percentage", "airborne_controller_time_percentage"
    )
    sectors = primary_sector(sector_breakdown(stays, base))
    out = base.join(contacts, FLIGHT_KEY, "left").join(
        sectors, ["callsign", "logon_time", "completion_time"], "left"
    )
    zero = F.lit(0).cast("int")
    return out.select(
        stable_id(*COMPLETED_KEY, "logon_time").alias("id"), at(as_of).alias("created_at"),
        *COMPLETED_KEY, *carried, "aircraft_short", "time_online_minutes", "completion_time",
        F.coalesce("controller_callsigns", F.create_map().cast(contacts.schema["controller_callsigns"].dataType)).alias("controller_callsigns"),
        F.coalesce("controller_time_percentage", F.lit(0.0)).cast("decimal(5,2)").alias("controller_time_percentage"),
        F.coalesce("airborne_controller_time_percentage", F.lit(0.0)).cast("decimal(5,2)").alias("airborne_controller_time_percentage"),
        F.col("primary_sector").alias("primary_enroute_sector"),
        F.coalesce("total_sectors", zero).alias("total_enroute_sectors"),
        F.coalesce("total_minutes", zero).alias("total_enroute_time_minutes"),
        F.coalesce("sector_breakdown", F.create_map().cast("map<string,int>")).alias("sector_breakdown"),
    )


# --- controllers ---------------------------------------------------------------


def completed_controllers(controllers: DataFrame, summaries: DataFrame, as_of, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Sessions whose newest row is older than the limit and not summarised.

    The rows are grouped to sessions first; the null-safe anti-join then runs
    on sessions.
    """
    sessions = upto(controllers, "last_updated", as_of).groupBy(*SESSION).agg(F.max("last_updated").alias("session_end_time"))
    sessions = sessions.where(F.col("session_end_time") < ago(as_of, mins=minutes))
    cs = summaries.select(
        F.col("callsign").alias("_c"), F.col("cid").alias("_i"), F.col("session_start_time").alias("_s")
    ).distinct()
    same = (
        (F.col("callsign") == F.col("_c")) & F.col("cid").eqNullSafe(F.col("_i")) & (F.col("logon_time") == F.col("_s"))
    )
    return sessions.join(cs, same, "left_anti")


def reconnect_rows(sessions: DataFrame, controllers: DataFrame, minutes: int = RECONNECT_MINUTES) -> DataFrame:
    """Rows of each session and of log-ons up to ``minutes`` after its end.

    One hop only. A NULL cid finds nothing. The result is keyed by
    (callsign, cid, session_start).
    """
    until = F.col("session_end_time") + F.make_interval(mins=F.lit(minutes))
    spans = sessions.where(F.col("cid").isNotNull()).select(
        F.col("callsign").alias("s_callsign"), F.col("cid").alias("s_cid"),
        F.col("logon_time").alias("session_start"), "session_end_time",
        F.greatest(F.col("logon_time"), until).alias("_until"),
    )
    return range_join(
        controllers, spans, "logon_time", "session_start", "_until",
        on=[("callsign", "s_callsign"), ("cid", "s_cid")],
    ).drop("s_callsign", "s_cid", "_until")


def controller_session_merge(sessions: DataFrame, controllers: DataFrame, minutes: int = RECONNECT_MINUTES) -> DataFrame:
    """Merged session per completed one: start, end, whole minutes and identity.

    First and last row go by creation time. A session of 0 minutes gets 1.
    """
    made = "created_at" if "created_at" in controllers.columns else "last_updated"
    order = F.struct(made, "id")
    identity = F.struct(*[c for c in ("name", "rating", "facility", "server") if c in controllers.columns], "logon_time")
    merged = reconnect_rows(sessions, controllers, minutes).groupBy("callsign", "cid", "session_start", "session_end_time").agg(
        F.min_by(identity, order).alias("_first"),
        F.max_by("last_updated", order).alias("_last"),
    )
    length = whole_minutes(F.col("_first.logon_time"), F.col("_last"))
    return merged.select(
        "callsign", "cid", F.col("session_start").alias("logon_time"), F.col("session_end_time").alias("unmerged_end"),
        *[F.col(f"_first.{c}") for c in ("name", "rating", "facility", "server") if c in controllers.columns],
        F.col("_first.logon_time").alias("session_start_time"),
        F.when(length == 0, F.col("_first.logon_time") + F.make_interval(mins=F.lit(1))).otherwise(F.col("_last")).alias("session_end_time"),
        F.when(length == 0, 1).otherwise(length).cast("int").alias("session_duration_minutes"),
    )


def session_frequencies(sessions: DataFrame, controllers: DataFrame) -> DataFrame:
    """Sorted distinct frequencies of log-ons inside each session.

    ``sessions`` has callsign, session_start, session_end; the id is ignored.
    """
    spans = sessions.select(F.col("callsign").alias("s_callsign"), "session_start", "session_end").distinct()
    used = controllers.where(F.col("frequency").isNotNull()).select("callsign", "logon_time", "frequency").distinct()
    rows = range_join(used, spans, "logon_time", "session_start", "session_end", on=[("callsign", "s_callsign")])
    return rows.groupBy("callsign", "session_start", "session_end").agg(
        F.sort_array(F.collect_set("frequency")).alias("frequencies_used")
    )


def build_controller_summaries(
    controllers: DataFrame, transceivers: DataFrame, summaries: DataFrame, as_of,
    minutes: int = SESSION_MINUTES, reconnect_minutes: int = RECONNECT_MINUTES, completed: DataFrame | None = None,
) -> DataFrame:
    """One summary per completed session, with its frequencies and aircraft.

    The merged sessions are written once, as three later steps read them. Rows
    later than ``as_of`` are left out.
    """
    controllers, transceivers = upto(controllers, "last_updated", as_of), upto(transceivers, "timestamp", as_of)
    if completed is None:
        completed = completed_controllers(controllers, summaries, as_of, minutes)
    merged = materialise(controller_session_merge(completed, controllers, reconnect_minutes), "sessions")
    sessions = merged.select(
        "callsign", F.col("logon_time").alias("session_start"), F.col("unmerged_end").alias("session_end")
    ).distinct()
    metrics = aircraft_metrics(match_controller_flight(sessions, transceivers))
    metrics = metrics.select(
        "callsign", F.col("session_start").alias("logon_time"), F.col("session_end").alias("unmerged_end"),
        "total_aircraft", "peak_count", "hourly_aircraft_breakdown", "aircraft_details",
    )
    used = session_frequencies(sessions, controllers).select(
        "callsign", F.col("session_start").alias("logon_time"), F.col("session_end").alias("unmerged_end"), "frequencies_used"
    )
    key = ["callsign", "logon_time", "unmerged_end"]
    kinds = {f.name: f.dataType for f in metrics.schema}
    return merged.join(metrics, key, "left").join(used, key, "left").select(
        stable_id("callsign", "cid", "logon_time", "unmerged_end").alias("id"), at(as_of).alias("created_at"),
        *[c for c in merged.columns if c not in ("logon_time", "unmerged_end")],
        F.coalesce("total_aircraft", F.lit(0)).cast("int").alias("total_aircraft_handled"),
        F.coalesce("peak_count", F.lit(0)).cast("int").alias("peak_aircraft_count"),
        F.coalesce("hourly_aircraft_breakdown", F.create_map().cast(kinds["hourly_aircraft_breakdown"])).alias("hourly_aircraft_breakdown"),
        F.coalesce("frequencies_used", F.array().cast("array<string>")).alias("frequencies_used"),
        F.coalesce("aircraft_details", F.array().cast(kinds["aircraft_details"])).alias("aircraft_details"),
    )


def archive_controllers(controllers: DataFrame, completed: DataFrame, as_of=None) -> DataFrame:
    """The rows of completed sessions, those there were at ``as_of`` if it is given."""
    controllers = controllers if as_of is None else upto(controllers, "last_updated", as_of)
    keys = completed.select("callsign", "logon_time").distinct()
    return controllers.join(keys, ["callsign", "logon_time"], "left_semi")


def remaining_controllers(controllers: DataFrame, completed: DataFrame, as_of=None) -> DataFrame:
    """All other rows."""
    keys = completed.select("callsign", "logon_time").distinct()
    if as_of is None:
        return controllers.join(keys, ["callsign", "logon_time"], "left_anti")
    keys = keys.select(F.col("callsign").alias("_callsign"), F.col("logon_time").alias("_logon"))
    same = (F.col("callsign") == F.col("_callsign")) & (F.col("logon_time") == F.col("_logon"))
    return controllers.join(keys, same & F.coalesce(F.col("last_updated") <= at(as_of), F.lit(False)), "left_anti")


# --- the two hourly runs ---------------------------------------------------------


@dataclass(frozen=True)
class Processed:
    """New tables of a run: Parquet has no DELETE, so they replace the old ones."""

    summaries: DataFrame
    archived: DataFrame
    remaining: DataFrame


def process_flights(
    flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, stays: DataFrame,
    summaries: DataFrame, as_of, hours: int = FLIGHT_HOURS,
) -> Processed:
    """identify -> summarise -> archive -> remove.

    The keys and the summaries are written once and handed on. Archived rows
    have the summary columns of their flight.
    """
    completed = materialise(completed_flights(flights, summaries, as_of, hours), "completed-flights")
    built = materialise(build_flight_summaries(
        flights, transceivers, controllers, stays, summaries, as_of, hours, completed=completed
    ), "flight-summaries")
    return Processed(
        built,
        with_summary_columns(archive_flights(flights, completed, as_of), built),
        remaining_flights(flights, completed, as_of),
    )


def process_controllers(
    controllers: DataFrame, transceivers: DataFrame, summaries: DataFrame, as_of, minutes: int = SESSION_MINUTES
) -> Processed:
    """The same for sessions. Only sessions that got a summary are removed: one
    without a cid finds no rows, gets none and stays."""
    completed = materialise(completed_controllers(controllers, summaries, as_of, minutes), "completed-sessions")
    done = completed.where(F.col("cid").isNotNull())
    return Processed(
        build_controller_summaries(controllers, transceivers, summaries, as_of, minutes, completed=completed),
        archive_controllers(controllers, done, as_of),
        remaining_controllers(controllers, done, as_of),
    )


def process_counts(run: Processed) -> DataFrame:
    """Rows of each part of a run."""
    parts = {"summaries": run.summaries, "archived": run.archived, "remaining": run.remaining}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


# --- runs that change the stored tables ----------------------------------------------

# The column by whose date each stored table is partitioned.
STORED_TIME = {
    "flights": "last_updated", "controllers": "last_updated", "transceivers": "timestamp",
    "flight_summaries": "completion_time", "flights_archive": "last_updated",
    "controller_summaries": "session_end_time", "controllers_archive": "last_updated",
    "flight_sector_occupancy": "entry_timestamp",
}
# Summaries are few rows a day, so a partition holds a month of them.
STORED_GRAIN = {"flight_summaries": "month", "controller_summaries": "month"}


def load_table(df: DataFrame, store: str, table: str, run: str = "load") -> tables.Version:
    """Put rows into a table of a store as a run of their own."""
    return tables.load(df, store, table, STORED_TIME[table], run, grain=STORED_GRAIN.get(table, "day"))


@dataclass(frozen=True)
class Staged:
    """A run whose files are written but which no reader sees yet."""

    store: str
    change: tables.Change
    summaries: int = 0
    archived: int = 0

    def publish(self, spark: SparkSession) -> tables.Version:
        return tables.publish(spark, self.store, self.change)


def _staged_run(
    spark: SparkSession, store: str, kind: str, run: str, now: tables.Version, names: tuple[str, str, str],
    built: DataFrame, archived: DataFrame, remaining: Callable[[DataFrame], DataFrame],
) -> Staged:
    """Stage the summaries, the archived rows and the rest of each partition that loses rows.

    Only partitions with archived rows are written again; all others stay as they are.
    """
    live, summary, archive = names
    made, n_made = tables.stage(built, store, summary, run, STORED_TIME[summary], grain=STORED_GRAIN[summary])
    moved, n_moved = tables.stage(archived, store, archive, run, STORED_TIME[archive])
    touched = {e.part for e in moved}
    old = [e for e in now.of(live) if e.part in touched]
    rest, _ = tables.stage(remaining(tables.read(spark, store, live, now, old)), store, live, run, STORED_TIME[live])
    change = tables.Change(
        kind, run, (*made, *moved, *rest), tuple(old), {summary: built.schema, archive: archived.schema})
    return Staged(store, change, n_made, n_moved)


def _or_empty(spark: SparkSession, store: str, table: str, now: tables.Version) -> DataFrame:
    if table in now.schemas:
        return tables.read(spark, store, table, now)
    return spark.createDataFrame([], schemas.TABLES[table])


def stage_flights_run(
    spark: SparkSession, store: str, as_of, hours: int = FLIGHT_HOURS, window: str = "logon",
) -> Staged | None:
    """Summarise and archive the completed flights of a store, and take their rows out of ``flights``.

    Nothing is visible before ``publish``. None where there is no work: no
    completed flight, or this run has been published already.
    """
    run = f"flights-{_run_name(as_of)}"
    now = tables.latest(spark, store)
    if now.marks.get("process_flights") == run:
        return None
    with owned_files(spark):
        flights, radios, staff, stays, summaries = (
            _or_empty(spark, store, name, now)
            for name in ("flights", "transceivers", "controllers", "flight_sector_occupancy", "flight_summaries"))
        completed = materialise(completed_flights(flights, summaries, as_of, hours), "completed-flights")
        built = materialise(build_flight_summaries(
            flights, radios, staff, stays, summaries, as_of, hours, window=window, completed=completed), "flight-summaries")
        if built.isEmpty():
            return None
        archived = with_summary_columns(archive_flights(flights, completed, as_of), built)
        return _staged_run(
            spark, store, "process_flights", run, now, ("flights", "flight_summaries", "flights_archive"), built, archived,
            lambda rows: remaining_flights(rows, completed, as_of))


def stage_controllers_run(spark: SparkSession, store: str, as_of, minutes: int = SESSION_MINUTES) -> Staged | None:
    """The same for controller sessions. Only sessions that got a summary are archived and removed."""
    run = f"controllers-{_run_name(as_of)}"
    now = tables.latest(spark, store)
    if now.marks.get("process_controllers") == run:
        return None
    with owned_files(spark):
        staff, radios, summaries = (
            _or_empty(spark, store, name, now) for name in ("controllers", "transceivers", "controller_summaries"))
        completed = materialise(completed_controllers(staff, summaries, as_of, minutes), "completed-sessions")
        built = materialise(build_controller_summaries(
            staff, radios, summaries, as_of, minutes, completed=completed), "controller-summaries")
        if built.isEmpty():
            return None
        done = completed.where(F.col("cid").isNotNull())
        archived = archive_controllers(staff, done, as_of)
        return _staged_run(
            spark, store, "process_controllers", run, now, ("controllers", "controller_summaries", "controllers_archive"),
            built, archived, lambda rows: remaining_controllers(rows, done, as_of))


def _run_name(as_of) -> str:
    return re.sub(r"[^0-9]", "", str(as_of))


def process_flights_written(spark: SparkSession, store: str, as_of, **options) -> dict[str, int]:
    """Stage and publish; the numbers of the run, all 0 where there was no work."""
    return _published(spark, stage_flights_run(spark, store, as_of, **options))


def process_controllers_written(spark: SparkSession, store: str, as_of, **options) -> dict[str, int]:
    return _published(spark, stage_controllers_run(spark, store, as_of, **options))


def _published(spark: SparkSession, run: Staged | None) -> dict[str, int]:
    if run is None:
        return {"summaries_created": 0, "records_archived": 0, "records_deleted": 0}
    run.publish(spark)
    return {"summaries_created": run.summaries, "records_archived": run.archived, "records_deleted": run.archived}


# --- archives ----------------------------------------------------------------------

SUMMARY_COLUMNS = [
    "deptime", "controller_callsigns", "controller_time_percentage", "time_online_minutes",
    "primary_enroute_sector", "total_enroute_sectors", "total_enroute_time_minutes",
    "sector_breakdown", "completion_time",
]


def _shared(archive: DataFrame, summaries: DataFrame, columns) -> list[str]:
    """The columns to fill, all of which both tables must have."""
    _need(archive, columns, "the archive")
    _need(summaries, columns, "the summaries")
    return list(columns)


def with_summary_columns(archived: DataFrame, summaries: DataFrame) -> DataFrame:
    """Archived rows with the summary columns, filled from the summary of the same key."""
    columns = [c for c in SUMMARY_COLUMNS if c not in COMPLETED_KEY]
    kinds = {f.name: f.dataType for f in summaries.schema}
    blank = archived.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns})
    return fill_archive_from_summary(blank, summaries)


def fill_archive_from_summary(
    archive: DataFrame, summaries: DataFrame, columns: Sequence[str] = SUMMARY_COLUMNS
) -> DataFrame:
    """Where any summary column of an archived row is NULL and a summary has the
    same five-column key, take all summary columns from it (the newest one).
    Both tables must have the ``columns``."""
    columns = _shared(archive, summaries, [c for c in columns if c not in COMPLETED_KEY])
    newest = summaries.dropna(subset=COMPLETED_KEY).groupBy(*COMPLETED_KEY).agg(
        F.max_by(F.struct(*columns), F.struct("completion_time", "id")).alias("_fs")
    )
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    filled = archive.join(newest, COMPLETED_KEY, "left").withColumn("_fill", gap & F.col("_fs").isNotNull())
    return filled.select(*[
        F.when(F.col("_fill"), F.col(f"_fs.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in archive.columns
    ])


def sync_archive_columns(archive: DataFrame, summaries: DataFrame, columns: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    """Fill each NULL summary column on its own, by callsign only, from the
    newest summary that has the column."""
    columns = _shared(archive, summaries, columns)
    newest = summaries.groupBy("callsign").agg(*[
        # max_by skips rows whose order is NULL, so only known values compete
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("completion_time", "id"))).alias(f"_{c}") for c in columns
    ])
    joined = archive.join(newest, "callsign", "left")
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in archive.columns
    ])


def archive_retention(archive: DataFrame, as_of, hours: int, time: str = "last_updated") -> DataFrame:
    """Rows that are not older than ``hours``."""
    return archive.where(F.col(time) >= ago(as_of, hours=hours))


def backfill_contacts(
    summaries: DataFrame, flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, window: str = "logon"
) -> DataFrame:
    """Contact share and controllers again for summaries without any."""
    text = object_text(summaries, "controller_callsigns")
    empty = summaries.where(text.isNull() | (text == "{}"))
    keys = empty.select(*FLIGHT_KEY).dropna().distinct()
    matches = match_flight_atc(flights, transceivers, controllers, window=window, keys=keys)
    found = atc_contact_metrics(matches, flights, keys=keys)
    return empty.select("id", *FLIGHT_KEY).join(found, FLIGHT_KEY, "left").select(
        "id", *FLIGHT_KEY, "controller_callsigns",
        F.coalesce("interactions_detected", F.lit(0)).alias("interactions_detected"),
        F.coalesce("controller_time_percentage", F.lit(0.0)).alias("controller_time_percentage"),
    )


# --- who is on line now ----------------------------------------------------------------


def active_flight_interactions(
    flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, as_of, secs: int = 180, window: str = "logon"
) -> DataFrame:
    """Flights seen in the last ``secs`` with their number of contacts."""
    flights, controllers = (upto(t, "last_updated", as_of) for t in (flights, controllers))
    transceivers = upto(transceivers, "timestamp", as_of)
    active = flights.where(F.col("last_updated") >= ago(as_of, secs=secs))
    keys = flight_keys(active)
    matches = match_flight_atc(flights, transceivers, controllers, window=window, keys=keys)
    found = matches.groupBy(F.col("flight_callsign").alias("callsign"), "departure", "arrival", "logon_time").agg(
        F.count(F.lit(1)).alias("n")
    )
    return keys.join(found, FLIGHT_KEY, "left").select(
        *FLIGHT_KEY, F.coalesce("n", F.lit(0)).alias("interactions_detected")
    )


def active_controller_interactions(
    controllers: DataFrame, transceivers: DataFrame, as_of, secs: int = 180
) -> DataFrame:
    """Controllers seen in the last ``secs`` with the aircraft since log-on."""
    controllers, transceivers = upto(controllers, "last_updated", as_of), upto(transceivers, "timestamp", as_of)
    sessions = controllers.where(F.col("last_updated") >= ago(as_of, secs=secs)).select(
        "callsign", F.col("logon_time").alias("session_start"), at(as_of).alias("session_end")
    ).distinct()
    found = match_controller_flight(sessions, transceivers).groupBy("callsign", "session_start").agg(
        F.countDistinct("flight_callsign").alias("n")
    )
    return sessions.join(found, ["callsign", "session_start"], "left").select(
        "callsign", F.col("session_start").alias("logon_time"), F.coalesce("n", F.lit(0)).alias("interactions_detected")
    )
