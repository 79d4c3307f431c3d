"""Queries of the sector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtrace.functions.values import at
from airtrace.operators import sectors as S
from airtrace.plans import flight_reports, integrity, requirements
from airtrace.registry.base import query, shared_cte
from airtrace.registry.derived import AS_OF_EVENTS as NOW
from airtrace.sources.reference import rectangle_sectors

E_NOW = f"timestamp '{NOW}'"
# a clock after the last poll at every scale closes what is open then
LATE = "2024-02-01 00:00:00"

_IN = "{a} > s.lat_min and {a} < s.lat_max and {b} > s.lon_min and {b} < s.lon_max"

shared_cte(
    "placed",
    f"""select f.*, (select s.sector_name from fx_sectors s where {_IN.format(a='f.latitude', b='f.longitude')} order by s.ord limit 1) as sector_name
from fx_flights f""",
)
shared_cte(
    "stay_rows",
    """select *, case when groundspeed is null or latitude is null or longitude is null then null
 when groundspeed >= 60 then coalesce(sector_name, '') else '' end as seen,
 case when epoch(last_updated) - epoch(lag(last_updated) over w) <= 300 then 0 else 1 end as brk
from placed window w as (partition by callsign order by last_updated, id)""",
)
shared_cte(
    "stay_sessions",
    "select *, sum(brk) over (partition by callsign order by last_updated, id) as session from stay_rows",
)
shared_cte(
    "stay_states",
    """select *, coalesce(last_value(seen ignore nulls) over (partition by callsign, session order by last_updated, id rows between unbounded preceding and current row), '') as state
from stay_sessions""",
)
shared_cte(
    "stay_changes",
    """select *, case when brk = 1 or state <> lag(state) over (partition by callsign order by last_updated, id) then 1 else 0 end as new_stay
from stay_states""",
)
shared_cte(
    "stay_islands",
    "select *, sum(new_stay) over (partition by callsign order by last_updated, id) as island from stay_changes",
)
shared_cte(
    "stays",
    """select callsign, sector_name, entry_timestamp, case when closed then b.t end as exit_timestamp,
 cast(case when closed then epoch(b.t) - epoch(entry_timestamp) else 0 end as int) as duration_seconds, a.lat as entry_lat, a.lon as entry_lon,
 case when closed then b.lat end as exit_lat, case when closed then b.lon end as exit_lon, a.alt as entry_altitude,
 case when closed then b.alt end as exit_altitude
from (select callsign, island, any_value(state) as sector_name, min(last_updated) as entry_timestamp,
  arg_min(struct_pack(t := last_updated, lat := latitude, lon := longitude, alt := altitude), struct_pack(t := last_updated, i := id)) as a,
  arg_max(struct_pack(t := last_updated, lat := latitude, lon := longitude, alt := altitude), struct_pack(t := last_updated, i := id)) as b,
  island <> max(island) over (partition by callsign) as closed
 from stay_islands group by callsign, island) where sector_name <> ''""",
)
shared_cte(
    "newest_row",
    "select * from (select *, row_number() over (partition by callsign order by last_updated desc, id desc) as rn from fx_flights) where rn = 1",
)
shared_cte(
    "closed_stays",
    f"""select s.callsign, s.sector_name, s.entry_timestamp,
 case when stale then n.last_updated else s.exit_timestamp end as exit_timestamp,
 cast(case when stale then epoch(n.last_updated) - epoch(s.entry_timestamp) else s.duration_seconds end as int) as duration_seconds, s.entry_lat, s.entry_lon,
 case when stale then n.latitude else s.exit_lat end as exit_lat, case when stale then n.longitude else s.exit_lon end as exit_lon, s.entry_altitude,
 case when stale then n.altitude else s.exit_altitude end as exit_altitude
from (select s.*, s.exit_timestamp is null and n.last_updated < timestamp '{LATE}' - interval 300 second as stale
 from stays s left join newest_row n on s.callsign = n.callsign) s left join newest_row n on s.callsign = n.callsign""",
)


def stays(t):
    return t.stays


def closed(t):
    return S.stale_sector_close(stays(t), t.flights, at(LATE))


@query("sector_for_point", "select id, sector_name from placed")
def sector_for_point(t):
    return S.sector_for_point(t.flights, rectangle_sectors(t.sector_rectangles)).select("id", "sector_name")


@query(
    "main_sector_for_point",
    f"""select f.id, m.main_sector from fx_flights f left join (select distinct f.id, s.main_sector from fx_flights f
 join fx_sectors s on {_IN.format(a='f.latitude', b='f.longitude')}) m on f.id = m.id""",
)
def main_sector_for_point(t):
    rectangles = t.sector_rectangles
    hierarchy = rectangles.select("main_sector", "sector_name")
    sectors = rectangle_sectors(rectangles).drop("main_sector")
    return S.main_sector_for_point(t.flights, sectors, hierarchy).select("id", "main_sector")


@query("sector_stays", "select * from stays")
def sector_stays(t):
    return t.computed_stays()


@query(
    "stale_sectors",
    f"""select distinct s.callsign, s.sector_name, s.entry_timestamp, n.latitude as new_lat, n.longitude as new_lon, n.altitude as new_altitude, n.last_updated as newest
from stays s join newest_row n on s.callsign = n.callsign where s.exit_timestamp is null and n.last_updated < timestamp '{LATE}' - interval 300 second""",
)
def stale_sectors(t):
    return S.stale_sectors(stays(t), t.flights, at(LATE))


@query(
    "stale_sector_count",
    f"""select count(*) as open_sectors_count, cast(coalesce(sum((select count(*) from fx_flights f where f.callsign = s.callsign
 and f.last_updated < {E_NOW} - interval 300 second)), 0) as bigint) as potentially_stale_sectors_count from stays s where s.exit_timestamp is null""",
)
def stale_sector_count(t):
    return S.stale_sector_count(stays(t), t.flights, at(NOW))


@query("stale_sector_close", "select * from closed_stays")
def stale_sector_close(t):
    return closed(t)


@query(
    "sector_exit",
    """select s.callsign, s.sector_name, s.entry_timestamp, case when s.exit_timestamp is null then n.last_updated else s.exit_timestamp end as exit_timestamp,
 cast(case when s.exit_timestamp is null then epoch(n.last_updated) - epoch(s.entry_timestamp) else s.duration_seconds end as int) as duration_seconds,
 case when s.exit_timestamp is null then n.altitude else s.exit_altitude end as exit_altitude
from stays s left join newest_row n on s.callsign = n.callsign""",
)
def sector_exit(t):
    found = stays(t)
    # every aircraft leaves all its sectors at its newest row
    newest = S.newest_rows(t.flights)
    exits = found.select("callsign", "sector_name").distinct().join(newest, "callsign").select(
        "callsign", "sector_name", F.col("newest").alias("exit_timestamp"), F.col("new_lat").alias("exit_lat"),
        F.col("new_lon").alias("exit_lon"), F.col("new_altitude").alias("exit_altitude"),
    )
    return S.sector_exit(found, exits).select(
        "callsign", "sector_name", "entry_timestamp", "exit_timestamp", "duration_seconds", "exit_altitude"
    )


shared_cte(
    "flight_spans",
    "select callsign, min(logon_time) as logon_time, max(last_updated) as completion_time from fx_flights group by 1",
)
shared_cte(
    "breakdown",
    """select f.callsign, f.logon_time, f.completion_time, s.sector_name, cast(sum(s.duration_seconds) // 60 as int) as minutes
from flight_spans f join closed_stays s on s.callsign = f.callsign and s.exit_timestamp is not null
 and s.entry_timestamp between f.logon_time and f.completion_time group by 1, 2, 3, 4 having sum(s.duration_seconds) // 60 > 0""",
)


def spans(t):
    return t.flights.groupBy("callsign").agg(
        F.min("logon_time").alias("logon_time"), F.max("last_updated").alias("completion_time")
    )


@query("sector_breakdown", "select * from breakdown")
def sector_breakdown(t):
    return S.sector_breakdown(closed(t), spans(t))


@query(
    "primary_sector",
    """select callsign, logon_time, completion_time, (array_agg(sector_name order by minutes desc, sector_name))[1] as primary_sector,
 cast(count(*) as int) as total_sectors, cast(sum(minutes) as int) as total_minutes from breakdown group by 1, 2, 3""",
)
def primary_sector(t):
    return S.primary_sector(S.sector_breakdown(closed(t), spans(t))).drop("sector_breakdown")


@query(
    "sector_open_counts",
    "select sector_name, count(*) as active_occupancies, count(case when exit_timestamp is null then 1 end) as open_occupancies from stays group by 1",
)
def sector_open_counts(t):
    return flight_reports.sector_open_counts(stays(t))


@query(
    "report_sector_transitions",
    """select from_sector, to_sector, count(*) as transitions from (select sector_name as from_sector,
 lead(sector_name) over (partition by callsign order by entry_timestamp, sector_name) as to_sector from stays) where to_sector is not null group by 1, 2""",
)
def report_sector_transitions(t):
    return requirements.report_sector_transitions(stays(t))


# summaries know a third of the callsigns only, so all three sources of a cid occur
_CID = f"""select s.callsign, s.sector_name, s.entry_timestamp, coalesce(
 (select min(f.cid) from fx_flights f where f.callsign = s.callsign and f.cid is not null and s.entry_timestamp between f.logon_time and f.last_updated),
 (select min(x.cid) from fx_flight_summaries x where x.callsign = s.callsign and x.cid is not null), 999999) as cid from stays s"""
shared_cte("stay_cids", _CID)


def _with_cid(t):
    return integrity.backfill_stay_cid(
        stays(t).select("callsign", "sector_name", "entry_timestamp"), t.flights, t.flight_summaries
    )


@query("backfill_stay_cid", "select * from stay_cids")
def backfill_stay_cid(t):
    return _with_cid(t)


# cids of callsigns that end in 7 are moved to unknown ones
shared_cte(
    "moved_cids",
    "select callsign, sector_name, entry_timestamp, case when callsign like '%7' then cid + 1 else cid end as cid from stay_cids",
)


@query(
    "orphan_stays",
    """select * from moved_cids s where not exists (select 1 from fx_flight_summaries x where x.cid = s.cid)
 and not exists (select 1 from fx_flights f where f.cid = s.cid)""",
)
def orphan_stays(t):
    cid = F.when(F.col("callsign").endswith("7"), F.col("cid") + 1).otherwise(F.col("cid"))
    return integrity.orphan_stays(_with_cid(t).withColumn("cid", cid), t.flights, t.flight_summaries)
