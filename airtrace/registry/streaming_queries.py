"""Queries that run as streams.

Each one lands the derived rows in the shared folder, streams them with
``availableNow`` and gives the stored result back as a batch frame.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from airtrace import schemas
from airtrace.operators import filters as X
from airtrace.registry.base import query
from airtrace.registry.filter_queries import (
    EXCLUDED_MHZ, RING, _IN_FLIGHT, _IN_RADIO, _KEPT, _offset, allowed,
)
from airtrace.registry.match_queries import LIMIT_CASE, NM
from airtrace.registry.source_queries import landed_polls
from airtrace.session import materialise, materialise_by, shared_folder
from airtrace.sources import tables
from airtrace.sources.reference import rectangle_sectors
from airtrace.sources.snapshots import src_snapshots
from airtrace.streaming import ingest, sector_stream, windows

# State partitions of these runs; a cluster sets its own number.
STATE_PARTITIONS = "8"


@contextmanager
def stream_settings(spark, **settings):
    """Settings of one stream, put back afterwards."""
    settings = {"spark.sql.shuffle.partitions": STATE_PARTITIONS, **settings}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _land(df, name: str) -> str:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _stream(t, df, name: str):
    path = _land(df, name)
    return t.spark.readStream.schema(df.schema).parquet(path)


@query(
    "ingest_poll",
    f"""select 'flights' as table_name, count(*) as n_rows, count(distinct callsign) as callsigns from parsed_flights
 where (latitude is null or longitude is null or {_IN_FLIGHT}) and departure <> '' and arrival <> ''
union all select 'controllers', count(*), count(distinct callsign) from fx_controllers where callsign in (select callsign from allowed)
union all select 'transceivers', count(*), count(distinct callsign) from fx_transceivers
 where (position_lat is null or position_lon is null or {_IN_RADIO}) and frequency not in (118000000, 118505000, 118700000)""",
)
def ingest_poll(t):
    out, state = shared_folder(t.spark, "ingested"), shared_folder(t.spark, "ingest-state")
    kept = ingest.Filters(boundary=RING, allow=allowed(t), excluded_mhz=EXCLUDED_MHZ)
    with stream_settings(t.spark):
        ingest.start_ingest(t.spark, landed_polls(t), out, state, kept, availableNow=True).awaitTermination()
    result = None
    for name in ("flights", "controllers", "transceivers"):
        row = ingest.ingested(t.spark, out, name).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("callsign").alias("callsigns")
        )
        result = row if result is None else result.unionByName(row)
    return result


_PLAN = "callsign, cid, logon_time, last_updated as seen"


@query(
    "ingest_compacted",
    f"""select 'flights' as table_name, {_PLAN}, aircraft_type, departure, arrival, latitude, longitude, null as frequency, null as entity_type from parsed_flights
 where (latitude is null or longitude is null or {_IN_FLIGHT}) and departure <> '' and arrival <> ''
union all select 'controllers', {_PLAN}, null, null, null, null, null, frequency, null from fx_controllers where callsign in (select callsign from allowed)
union all select 'transceivers', t.callsign, null, null, t.ts, null, null, null, t.position_lat, t.position_lon, cast(t.frequency as varchar),
  case when f.callsign is null and c.callsign is not null then 'atc' else 'flight' end from fx_transceivers t
 left join (select distinct callsign, last_updated from fx_flights) f on f.callsign = t.callsign and f.last_updated = t.ts
 left join (select distinct callsign, last_updated from fx_controllers) c on c.callsign = t.callsign and c.last_updated = t.ts
 where (t.position_lat is null or t.position_lon is null or {_IN_RADIO}) and t.frequency not in (118000000, 118505000, 118700000)""",
)
def ingest_compacted(t):
    """All stored rows after batches, a batch that ran again, compaction and vacuum."""
    out, state = shared_folder(t.spark, "ingested"), shared_folder(t.spark, "ingest-state")
    kept = ingest.Filters(boundary=RING, allow=allowed(t), excluded_mhz=EXCLUDED_MHZ)
    polls = landed_polls(t)
    with stream_settings(t.spark):
        ingest.start_ingest(t.spark, polls, out, state, kept, files_per_batch=3, availableNow=True).awaitTermination()
        stream = next(k for k in tables.latest(t.spark, out).marks if k.startswith("ingest-")).removeprefix("ingest-")
        last = int(tables.latest(t.spark, out).marks[f"ingest-{stream}"].rsplit("-", 1)[1])
        ingest.ingest_batch(src_snapshots(t.spark, polls, schemas.POLL), out, kept, stream, last)  # done already
        ingest.compact_ingested(t.spark, out)
        tables.vacuum(t.spark, out, keep=1)
    columns = ["callsign", "cid", "logon_time", "seen", "aircraft_type", "departure", "arrival", "latitude", "longitude", "frequency", "entity_type"]
    named = {"timestamp": "seen", "last_updated": "seen", "position_lat": "latitude", "position_lon": "longitude"}
    result = None
    for name in ("flights", "controllers", "transceivers"):
        rows = ingest.ingested(t.spark, out, name).withColumnsRenamed(named)
        rows = rows.select(F.lit(name).alias("table_name"), *[
            F.col(c).cast("string" if c == "frequency" else rows.schema[c].dataType).alias(c) if c in rows.columns else F.lit(None).alias(c) for c in columns])
        result = rows if result is None else result.unionByName(rows)
    return result


@query(
    "ingest_poll_batch",
    f"""select callsign, aircraft_type, departure, arrival, last_updated from parsed_flights
where (latitude is null or longitude is null or {_IN_FLIGHT}) and departure <> '' and arrival <> ''""",
)
def ingest_poll_batch(t):
    polls = src_snapshots(t.spark, landed_polls(t), schemas.POLL)
    flights = ingest.ingest_poll(polls, ingest.Filters(boundary=RING))["flights"]
    return flights.select("callsign", "aircraft_type", "departure", "arrival", "last_updated")


def _land_in_order(df, name: str, time: str, files: int) -> str:
    """Land rows as files that follow each other in time, some rows one file late."""
    path = shared_folder(df.sparkSession, name)
    span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    width = max((span.b - span.a).total_seconds(), 1) / files
    # every seventh row comes a minute late; the watermark is further behind
    seen = F.unix_seconds(time) + F.when(F.pmod("id", F.lit(7)) == 0, 60).otherwise(0)
    nth = F.floor((seen - F.unix_seconds(F.lit(span.a))) / width)
    # dealt out once by all tasks; a file then reads the rows of its own folder only
    dealt = materialise_by(df.withColumn("_nth", F.least(nth, F.lit(files - 1)).cast("int")), f"{name}-dealt", "_nth")
    for i in range(files):
        dealt.where(F.col("_nth") == i).drop("_nth").coalesce(1).write.mode("append").parquet(path)
    return path


@query("sector_stays_stream", "select * from stays")
def sector_stays_stream(t):
    """Ten micro-batches with late rows; closed stays from the sink, open ones from the state."""
    columns = ["id", "callsign", "latitude", "longitude", "altitude", "groundspeed", "last_updated"]
    out, state = shared_folder(t.spark, "stays"), shared_folder(t.spark, "stays-state")
    flights = t.flights.select(*columns)
    # a poll without aircraft two minutes after the last one, so that the watermark passes all rows
    tick = flights.agg((F.max("last_updated") + F.expr("interval 2 minutes")).alias("last_updated")).select(
        *[F.col(c) if c == "last_updated" else F.lit("-" if c == "callsign" else None).cast(flights.schema[c].dataType).alias(c) for c in columns])
    with stream_settings(t.spark, **{"spark.sql.streaming.stateStore.providerClass": sector_stream.PROVIDER}):
        path = _land_in_order(flights, "positions", "last_updated", 10)
        tick.coalesce(1).write.mode("append").parquet(path)
        rows = t.spark.readStream.schema(flights.schema).option("maxFilesPerTrigger", 1).parquet(path)
        found = sector_stream.sector_stays_stream(rows, rectangle_sectors(t.sector_rectangles), "2 minutes")
        windows.start_append(found, out, state, availableNow=True).awaitTermination()
        held = materialise(sector_stream.open_stays(t.spark, state), "open-stays")
    return t.spark.read.schema(sector_stream.STAY).parquet(out).unionByName(held)


@query(
    "filter_daily_stats_stream",
    f"""select cast(ts as date) as day, count(*) as processed, count(case when {_KEPT} then 1 end) as included,
 count(case when not ({_KEPT}) then 1 end) as excluded from fx_transceivers group by 1""",
)
def filter_daily_stats_stream(t):
    out, state = shared_folder(t.spark, "daily"), shared_folder(t.spark, "daily-state")
    kept = X.frequency_kept(F.col("frequency"), EXCLUDED_MHZ)
    with stream_settings(t.spark):
        radios = _stream(t, _offset(t).select("frequency", "timestamp"), "radios")
        counts = windows.daily_filter_counts(radios, kept)
        windows.start_updates(counts, out, state, availableNow=True).awaitTermination()
    return windows.newest_updates(t.spark, out, "day")


@query(
    "live_matches_stream",
    f"""select f.callsign as flight_callsign, a.callsign as atc_callsign, f.ts as flight_time, a.ts as atc_time, f.frequency, a.frequency as atc_frequency
from fx_transceivers f join fx_transceivers a on f.entity_type = 'flight' and a.entity_type = 'atc' and abs(f.frequency - a.frequency) <= 5000
 and abs(epoch(f.ts) - epoch(a.ts)) <= 180
where {NM.format(a='f.position_lat', b='f.position_lon', c='a.position_lat', d='a.position_lon')} <= {LIMIT_CASE.format(c='a.callsign')}""",
)
def live_matches_stream(t):
    columns = ["callsign", "frequency", "position_lat", "position_lon", "timestamp"]
    out, state = shared_folder(t.spark, "live"), shared_folder(t.spark, "live-state")
    with stream_settings(t.spark):
        flights = _stream(t, t.transceivers.where("entity_type = 'flight'").select(*columns), "flight-radios")
        atc = _stream(t, t.transceivers.where("entity_type = 'atc'").select(*columns), "atc-radios")
        windows.start_append(windows.live_matches(flights, atc), out, state, availableNow=True).awaitTermination()
    return t.spark.read.parquet(out).select(
        "flight_callsign", "atc_callsign", "flight_time", "atc_time", "frequency", "atc_frequency"
    )
