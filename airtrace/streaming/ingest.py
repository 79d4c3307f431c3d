"""The poll pipeline: landed documents to three filtered, stored tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airtrace import schemas
from airtrace.functions.values import parse_utc, stable_id
from airtrace.operators.filters import (
    Ring, filter_boundary_flights, filter_boundary_transceivers, filter_callsign_pattern,
    filter_controller_allowlist, filter_frequency, filter_incomplete_plan,
)
from airtrace.session import at_once, sortable_times
from airtrace.sources import tables
from airtrace.sources.snapshots import (
    link_transceivers, parse_controllers, parse_flights, parse_transceivers, stream_snapshots,
)

# What tells the rows of one poll apart.
ROW_KEYS = {
    "flights": ("callsign", "cid", "logon_time"),
    "controllers": ("callsign", "cid", "frequency", "logon_time"),
    "transceivers": ("callsign", "transceiver_id", "frequency", "position_lat", "position_lon", "entity_type"),
}
TIME_COLUMNS = {"flights": "last_updated", "controllers": "last_updated", "transceivers": "timestamp"}
# Radios of aircraft and of stations are read apart, so they are stored apart below the date.
KINDS = {"transceivers": ("entity_type",)}


@dataclass(frozen=True)
class Filters:
    """What a poll keeps. The callsign patterns are off by default."""

    boundary: Ring | None = None
    allow: DataFrame | None = None
    excluded_mhz: Sequence[float | str] = ()
    callsign_patterns: Sequence[str] = ()


def ingest_poll(polls: DataFrame, filters: Filters) -> dict[str, DataFrame]:
    """Parse, link and filter poll documents; works on any number of polls.

    Radios are linked against the unfiltered lists of their own poll, and one
    without a time takes the time of the poll. A row's ``id`` is made from the
    poll and the row, so that a batch that runs again gives it again.
    """
    poll = ("poll_time",)
    flights, controllers = parse_flights(polls, poll), parse_controllers(polls, poll)
    radios = link_transceivers(parse_transceivers(polls, poll), flights, controllers, ("poll_time", "callsign"))
    radios = radios.withColumn("timestamp", F.coalesce("timestamp", parse_utc(F.col("poll_time"))))
    if filters.boundary is not None:
        flights = filter_boundary_flights(flights, filters.boundary)
        radios = filter_boundary_transceivers(radios, filters.boundary)
    if filters.allow is not None:
        controllers = filter_controller_allowlist(controllers, filters.allow)
    if filters.callsign_patterns:
        radios = filter_callsign_pattern(radios, filters.callsign_patterns)
    radios = filter_frequency(radios, filters.excluded_mhz)
    out = {"flights": filter_incomplete_plan(flights), "controllers": controllers, "transceivers": radios}
    return {
        name: df.withColumns({
            "id": stable_id("poll_time", *ROW_KEYS[name]), "created_at": parse_utc(F.col("poll_time")),
        }).drop("poll_time")
        for name, df in out.items()
    }


def ingest_batch(polls: DataFrame, store: str, filters: Filters, stream: str, batch: int) -> tables.Version:
    """Stage the rows of one batch of polls in all three tables and publish them together.

    The polls are read and parsed from JSON once; the tables are then staged at
    the same time, since each has small jobs. A batch that has been published
    is not taken again; one that died before leaves nothing that is seen, and
    overwrites its own files.
    """
    spark, run = polls.sparkSession, f"{stream}-{batch}"
    now = tables.latest(spark, store)
    if now.marks.get(f"ingest-{stream}") == run:
        return now
    if any(e.run == run for e in now.entries):
        raise RuntimeError(f"run {run} is in the store already: a new stream needs a checkpoint folder of its own")
    polls = polls.persist()
    try:
        polls.count()  # else each table's job would parse what the others have not kept yet
        found = ingest_poll(polls, filters)
        with sortable_times(spark):  # set here, since the threads share the session
            staged = at_once(spark, [
                lambda name=name, df=df: tables.stage(df, store, name, run, TIME_COLUMNS[name], KINDS.get(name, ()))
                for name, df in found.items()])
    finally:
        polls.unpersist()
    added = [e for entries, _ in staged for e in entries]
    schemas_ = {name: df.schema for name, df in found.items()}
    return tables.publish(spark, store, tables.Change(f"ingest-{stream}", run, tuple(added), (), schemas_))


def start_ingest(
    spark: SparkSession, landing: str, out: str, checkpoint: str, filters: Filters, files_per_batch: int = 1000,
    **trigger,
) -> StreamingQuery:
    """Stream the landing folder into the three tables of a store, a published run per micro-batch.

    Runs are named by the checkpoint folder and the batch. Call ``compact_ingested``
    from time to time: a minute makes small files.
    """
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    polls = stream_snapshots(spark, landing, schemas.POLL, files_per_batch)
    return (
        polls.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, out, filters, stream, number) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def ingested(spark: SparkSession, out: str, name: str, **where) -> DataFrame:
    """The stored rows of one table; ``since`` and ``until`` are dates."""
    return tables.read(spark, out, name, **where)


def compact_ingested(spark: SparkSession, out: str) -> tables.Version:
    """Merge what many batches have added to a date; readers see the old files or the new ones, never both."""
    version = tables.latest(spark, out)
    with sortable_times(spark):  # set here, since the threads share the session
        changes = at_once(spark, [
            lambda name=name, time=time: tables.staged_compaction(spark, out, name, time, version, KINDS.get(name, ()))
            for name, time in TIME_COLUMNS.items()])
    for change in changes:
        if change is not None:
            version = tables.publish(spark, out, change)
    return version
