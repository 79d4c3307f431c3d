"""Queries of the pipelines that turn stored rows into summaries and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtrace.functions.values import at, upto
from airtrace.operators.sectors import stale_sector_close
from airtrace.plans import lifecycle as L
from airtrace.registry.base import query, ratio_sql, shared_cte
from airtrace.registry.derived import AS_OF_EVENTS as NOW, AS_OF_ORDERS as ORDERS_NOW
from airtrace.registry.match_queries import LIMIT_CASE, NM, TYPE_CASE
from airtrace.registry.sector_queries import LATE, stays
from airtrace.session import shared_folder
from airtrace.sources import tables

E_NOW = f"timestamp '{NOW}'"
O_NOW = f"timestamp '{ORDERS_NOW}'"
HOURS = 1
KEY = "callsign, departure, arrival, cid, deptime"

# Flights summarised already: those from one airport.
shared_cte("known_summaries", "select * from fx_flight_summaries where departure = 'YBBN'")
shared_cte(
    "done_flights",
    f"""select distinct {KEY} from fx_flights where last_updated < {E_NOW} - interval {HOURS} hour
 and callsign not in (select callsign from known_summaries)""",
)
_SAME = " and ".join(f"f.{c} = d.{c}" for c in KEY.split(", "))
# a row of a completed flight that was there at the time
_ROW_DONE = f"(f.last_updated <= {E_NOW} and exists (select 1 from done_flights d where {_SAME}))"


def known(t):
    return t.flight_summaries.where(F.col("departure") == "YBBN")


def done(t):
    return L.completed_flights(t.flights, known(t), NOW, HOURS)


@query("completed_flights", "select * from done_flights")
def completed_flights(t):
    return done(t)


@query("archive_flights", f"select f.id, f.callsign, f.last_updated from fx_flights f where {_ROW_DONE}")
def archive_flights(t):
    return L.archive_flights(t.flights, done(t), NOW).select("id", "callsign", "last_updated")


@query("remaining_flights", f"select f.id, f.callsign, f.last_updated from fx_flights f where not {_ROW_DONE}")
def remaining_flights(t):
    return L.remaining_flights(t.flights, done(t), NOW).select("id", "callsign", "last_updated")


shared_cte(
    "flight_base",
    f"""select f.callsign, f.departure, f.arrival, f.cid, f.deptime, arg_min(f.logon_time, struct_pack(a := f.last_updated, b := f.id)) as logon_time,
 arg_min(f.aircraft_type, struct_pack(a := f.last_updated, b := f.id)) as aircraft_type,
 arg_min(f.flight_rules, struct_pack(a := f.last_updated, b := f.id)) as flight_rules, arg_min(f.name, struct_pack(a := f.last_updated, b := f.id)) as name, max(f.last_updated) as completion_time,
 cast((epoch(max(f.last_updated)) - epoch(min(f.last_updated))) // 60 as int) as time_online_minutes
from fx_flights_then f join done_flights d on {_SAME} group by 1, 2, 3, 4, 5""",
)
shared_cte(
    "base_breakdown",
    f"""select f.callsign, f.logon_time, f.completion_time, s.sector_name, sum(s.duration_seconds) // 60 as minutes
from (select distinct callsign, logon_time, completion_time from flight_base) f join closed_stays s on s.callsign = f.callsign
 and s.exit_timestamp <= timestamp '{NOW}' and s.entry_timestamp between f.logon_time and f.completion_time
group by 1, 2, 3, 4 having sum(s.duration_seconds) // 60 > 0""",
)
shared_cte(
    "base_contacts_then",
    """select flight_callsign as callsign, departure, arrival, logon_time, count(*) as n from whole_pairs_then group by 1, 2, 3, 4""",
)
shared_cte(
    "base_contacts",
    """select flight_callsign as callsign, departure, arrival, logon_time, count(*) as n, count(distinct atc_callsign) as controllers
from whole_pairs group by 1, 2, 3, 4""",
)


# All columns of a summary. Maps are written as text in order of their keys.
for _window, _pairs in (("whole", "whole_pairs_then"), ("logon", "logon_pairs_then")):
    shared_cte(
        f"{_window}_contacts",
        f"""select callsign, departure, arrival, logon_time, cast(sum(n) as bigint) as n, string_agg(concat_ws('/', atc_callsign, type, n, n,
  strftime(first_contact, '%Y-%m-%d %H:%M:%S'), strftime(last_contact, '%Y-%m-%d %H:%M:%S')), ';' order by atc_callsign) as controllers
from (select flight_callsign as callsign, departure, arrival, logon_time, atc_callsign, {TYPE_CASE.format(c='atc_callsign')} as type,
  count(*) as n, min(flight_time) as first_contact, max(flight_time) as last_contact from {_pairs} group by 1, 2, 3, 4, 5) group by 1, 2, 3, 4""",
    )
    _SHARE = f"cast(least(100e0, coalesce({ratio_sql('c.n', 'k.n', 1, 100)}, 0)) as double)"
    shared_cte(
        f"{_window}_summaries",
        f"""select b.callsign, b.departure, b.arrival, b.cid, b.deptime, b.logon_time, b.aircraft_type, b.aircraft_type as aircraft_short,
 b.flight_rules, b.name, cast(null as varchar) as route, b.completion_time, b.time_online_minutes, {E_NOW} as created_at,
 coalesce(c.controllers, '') as controllers, {_SHARE} as controller_time_percentage, {_SHARE} as airborne_controller_time_percentage,
 s.primary_sector as primary_enroute_sector, cast(coalesce(s.total_sectors, 0) as int) as total_enroute_sectors,
 cast(coalesce(s.total_minutes, 0) as int) as total_enroute_time_minutes, coalesce(s.sectors, '') as sectors
from flight_base b
left join {_window}_contacts c on c.callsign = b.callsign and c.departure = b.departure and c.arrival = b.arrival and c.logon_time = b.logon_time
left join flight_keys_then k on k.callsign = b.callsign and k.departure = b.departure and k.arrival = b.arrival and k.logon_time = b.logon_time
left join (select callsign, logon_time, completion_time, (array_agg(sector_name order by minutes desc, sector_name))[1] as primary_sector,
  count(*) as total_sectors, sum(minutes) as total_minutes,
  string_agg(concat(sector_name, ':', cast(minutes as bigint)), ',' order by sector_name) as sectors from base_breakdown group by 1, 2, 3) s
 on s.callsign = b.callsign and s.logon_time = b.logon_time and s.completion_time = b.completion_time""",
    )

SUMMARY_ROW = [
    *KEY.split(", "), "logon_time", "aircraft_type", "aircraft_short", "flight_rules", "name", "route", "completion_time",
    "time_online_minutes", "created_at", "controllers", "controller_time_percentage", "airborne_controller_time_percentage",
    "primary_enroute_sector", "total_enroute_sectors", "total_enroute_time_minutes", "sectors",
]


def summary_text(df):
    """A summary with its maps as text and its shares as numbers."""

    def contact(e):
        v = e["value"]
        clock = [F.date_format(v[n], "yyyy-MM-dd HH:mm:ss") for n in ("first_contact", "last_contact")]
        minutes = F.round(v["time_minutes"]).cast("long").cast("string")
        return F.concat_ws("/", e["key"], v["type"], minutes, v["contact_count"].cast("string"), *clock)

    def sector(e):
        return F.concat_ws(":", e["key"], e["value"].cast("string"))

    def text(name, entry, by):
        # an archived row without a summary has no map
        return F.array_join(F.array_sort(F.transform(F.map_entries(name), entry)), by)

    return df.withColumns({
        "controllers": text("controller_callsigns", contact, ";"), "sectors": text("sector_breakdown", sector, ","),
        "controller_time_percentage": F.col("controller_time_percentage").cast("double"),
    })


def closed_stays(t):
    return stale_sector_close(stays(t), t.flights, at(LATE))


def _build_flight_summaries(t, window):
    out = L.build_flight_summaries(
        t.flights, t.transceivers, t.controllers, closed_stays(t), known(t), NOW, HOURS, window=window)
    share = F.col("airborne_controller_time_percentage").cast("double")
    return summary_text(out).withColumn("airborne_controller_time_percentage", share).select(*SUMMARY_ROW)


@query("build_flight_summaries", "select * from whole_summaries")
def build_flight_summaries(t):
    return _build_flight_summaries(t, "flight")


@query("build_flight_summaries_logon", "select * from logon_summaries")
def build_flight_summaries_logon(t):
    return _build_flight_summaries(t, "logon")


@query(
    "process_flights",
    f"""select 'summaries' as part, count(*) as n_rows from flight_base
union all select 'archived', count(*) from fx_flights f where {_ROW_DONE}
union all select 'remaining', count(*) from fx_flights f where not {_ROW_DONE}""",
)
def process_flights(t):
    run = L.process_flights(t.flights, t.transceivers, t.controllers, stays(t), known(t), NOW, HOURS)
    return L.process_counts(run)


_FLIGHT_ROW = "f.callsign, f.departure, f.arrival, f.cid, f.deptime, f.logon_time, f.aircraft_type, f.flight_rules, f.name, f.last_updated"
_FILLED = (
    "completion_time", "time_online_minutes", "controllers", "controller_time_percentage", "primary_enroute_sector",
    "total_enroute_sectors", "total_enroute_time_minutes", "sectors",
)


@query(
    "process_flights_written",
    f"""select 'flights' as part, f.id, {_FLIGHT_ROW}, {', '.join(f'null as {c}' for c in _FILLED)}
from fx_flights f where not {_ROW_DONE}
union all select 'flights_archive', f.id, {_FLIGHT_ROW}, {', '.join(f's.{c}' for c in _FILLED)}
from fx_flights_then f join done_flights d on {_SAME} left join logon_summaries s on {' and '.join(f's.{c} = f.{c}' for c in KEY.split(', '))}
union all select 'flight_summaries', null, callsign, departure, arrival, cid, deptime, logon_time, aircraft_type, flight_rules, name, null, {', '.join(_FILLED)}
from logon_summaries
union all select 'flight_summaries', id, callsign, departure, arrival, cid, deptime, logon_time, aircraft_type, flight_rules, name, null, completion_time,
 {', '.join('null' for _ in _FILLED[1:])} from known_summaries""",
)
def process_flights_written(t):
    """The three tables of a store after a run that was given up, the run, and the run once more."""
    store = shared_folder(t.spark, "store")
    earlier = known(t).select(
        "id", *KEY.split(", "), "logon_time", "aircraft_type", "flight_rules", "name", "completion_time")
    for name, df in (
        ("flights", t.flights), ("transceivers", t.transceivers), ("controllers", t.controllers),
        ("flight_sector_occupancy", closed_stays(t)), ("flight_summaries", earlier),
    ):
        L.load_table(df, store, name)
    L.stage_flights_run(t.spark, store, NOW, hours=HOURS)  # not published: leaves nothing but files
    for _ in range(2):
        L.process_flights_written(t.spark, store, NOW, hours=HOURS)

    def rows(name):
        df = tables.read(t.spark, store, name)
        df = summary_text(df) if name != "flights" else df
        columns = ["id", *KEY.split(", "), "logon_time", "aircraft_type", "flight_rules", "name", "last_updated", *_FILLED]
        own = F.col("id") if name != "flight_summaries" else F.when(F.col("created_at").isNull(), F.col("id"))
        df = df.withColumn("id", own)
        return df.select(F.lit(name).alias("part"), *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])

    out = rows("flights_archive").unionByName(rows("flight_summaries")).unionByName(rows("flights"))
    return out


# --- controllers ---

# Summaries already made: the sessions of stations 0 and 5 (station 5 has no cid).
shared_cte(
    "known_sessions",
    "select distinct callsign, cid, logon_time as session_start_time from fx_controllers where callsign in ('STN0_GND', 'STN5_APP') and last_updated < timestamp '2024-01-01 00:40:00'",
)
shared_cte(
    "done_sessions",
    f"""select callsign, cid, logon_time, max(last_updated) as session_end_time from fx_controllers_then c where not exists (
 select 1 from known_sessions s where s.callsign = c.callsign and s.cid is not distinct from c.cid and s.session_start_time = c.logon_time)
group by 1, 2, 3 having max(last_updated) < {E_NOW} - interval 30 minute""",
)


def known_sessions(t):
    return t.controllers.where(
        F.col("callsign").isin("STN0_GND", "STN5_APP") & (F.col("last_updated") < at("2024-01-01 00:40:00"))
    ).select("callsign", "cid", F.col("logon_time").alias("session_start_time")).distinct()


def staff_then(t):
    return upto(t.controllers, "last_updated", NOW)


def done_sessions(t):
    return L.completed_controllers(t.controllers, known_sessions(t), NOW)


@query("completed_controllers", "select * from done_sessions")
def completed_controllers(t):
    return done_sessions(t)


@query(
    "reconnect_rows",
    """select c.id, c.callsign, c.cid, c.logon_time, s.logon_time as session_start from done_sessions s
join fx_controllers_then c on c.callsign = s.callsign and c.cid = s.cid
 and c.logon_time >= s.logon_time and c.logon_time <= greatest(s.logon_time, s.session_end_time + interval 5 minute)""",
)
def reconnect_rows(t):
    rows = L.reconnect_rows(done_sessions(t), staff_then(t))
    return rows.select("id", "callsign", "cid", "logon_time", "session_start")


shared_cte(
    "merged_sessions",
    """select callsign, cid, logon_time, session_end_time as unmerged_end, name, rating, start_time as session_start_time,
 case when minutes = 0 then start_time + interval 1 minute else end_time end as session_end_time,
 cast(case when minutes = 0 then 1 else minutes end as int) as session_duration_minutes
from (select *, (epoch(end_time) - epoch(start_time)) // 60 as minutes from (
 select s.callsign, s.cid, s.logon_time, s.session_end_time, arg_min(c.name, struct_pack(a := c.last_updated, b := c.id)) as name,
  arg_min(c.rating, struct_pack(a := c.last_updated, b := c.id)) as rating,
  arg_min(c.logon_time, struct_pack(a := c.last_updated, b := c.id)) as start_time, arg_max(c.last_updated, struct_pack(a := c.last_updated, b := c.id)) as end_time
 from done_sessions s join fx_controllers_then c on c.callsign = s.callsign and c.cid = s.cid
  and c.logon_time >= s.logon_time and c.logon_time <= greatest(s.logon_time, s.session_end_time + interval 5 minute)
 group by 1, 2, 3, 4))""",
)


@query("controller_session_merge", "select * from merged_sessions")
def controller_session_merge(t):
    return L.controller_session_merge(done_sessions(t), staff_then(t)).drop("facility")


shared_cte(
    "used_frequencies",
    """select s.callsign, s.logon_time, s.unmerged_end, string_agg(distinct c.frequency, ',' order by c.frequency) as frequencies
from (select distinct callsign, logon_time, unmerged_end from merged_sessions) s join fx_controllers_then c on c.callsign = s.callsign
 and c.logon_time between s.logon_time and s.unmerged_end and c.frequency is not null group by 1, 2, 3""",
)


@query(
    "session_frequencies",
    """select s.callsign, s.session_start, s.session_end, string_agg(distinct c.frequency, ',' order by c.frequency) as frequencies_used
from ctl_sessions s join fx_controllers c on c.callsign = s.callsign and c.logon_time between s.session_start and s.session_end
where c.frequency is not null group by 1, 2, 3""",
)
def session_frequencies(t):
    from airtrace.registry.match_queries import sessions

    out = L.session_frequencies(sessions(t), t.controllers)
    return out.withColumn("frequencies_used", F.array_join("frequencies_used", ","))


shared_cte(
    "merged_pairs",
    f"""select s.callsign, s.logon_time, s.unmerged_end, f.callsign as aircraft, min(f.ts) as first_seen, max(f.ts) as last_seen, count(*) as n,
 arg_min(a.frequency, struct_pack(a := f.ts, b := a.ts, c := a.frequency)) as frequency
from (select distinct callsign, logon_time, unmerged_end from merged_sessions) s
join fx_transceivers_then a on a.entity_type = 'atc' and a.callsign = s.callsign and a.ts between s.logon_time and s.unmerged_end
join fx_transceivers_then f on f.entity_type = 'flight' and f.ts between s.logon_time and s.unmerged_end
 and abs(f.frequency - a.frequency) <= 5000 and abs(epoch(f.ts) - epoch(a.ts)) <= 180
where {NM.format(a='a.position_lat', b='a.position_lon', c='f.position_lat', d='f.position_lon')} <= {LIMIT_CASE.format(c='s.callsign')}
group by 1, 2, 3, 4""",
)
_HOURS = " || ',' || ".join(
    f"cast(count(case when {h} between hour(first_seen) and hour(last_seen) then 1 end) as varchar)" for h in range(24))
shared_cte(
    "full_controller_summaries",
    f"""select m.callsign, m.cid, m.name, m.rating, m.session_start_time, m.session_end_time, m.session_duration_minutes, {E_NOW} as created_at,
 cast(coalesce(a.n, 0) as int) as total_aircraft_handled, cast(coalesce(a.n, 0) as int) as peak_aircraft_count, coalesce(u.frequencies, '') as frequencies_used,
 coalesce(a.hours, '') as hours, coalesce(a.details, '') as details
from merged_sessions m left join used_frequencies u on u.callsign = m.callsign and u.logon_time = m.logon_time and u.unmerged_end = m.unmerged_end
left join (select callsign, logon_time, unmerged_end, count(*) as n, {_HOURS} as hours,
  string_agg(concat_ws('/', aircraft, frequency, strftime(first_seen, '%Y-%m-%d %H:%M:%S'), strftime(last_seen, '%Y-%m-%d %H:%M:%S'),
   cast((epoch(last_seen) - epoch(first_seen)) // 60 as bigint), n), ';' order by aircraft) as details
 from merged_pairs group by 1, 2, 3) a on a.callsign = m.callsign and a.logon_time = m.logon_time and a.unmerged_end = m.unmerged_end""",
)

SESSION_ROW = [
    "callsign", "cid", "name", "rating", "session_start_time", "session_end_time", "session_duration_minutes", "created_at",
    "total_aircraft_handled", "peak_aircraft_count", "frequencies_used", "hours", "details",
]


def session_text(df):
    """A session's summary with its lists as text."""

    def detail(d):
        clock = [F.date_format(d[n], "yyyy-MM-dd HH:mm:ss") for n in ("first_seen", "last_seen")]
        hz = F.round(d["frequency_mhz"] * 1_000_000).cast("long").cast("string")
        counts = [d[n].cast("string") for n in ("time_on_frequency_minutes", "updates_count")]
        return F.concat_ws("/", d["callsign"], hz, *clock, *counts)

    hours = F.transform(F.array_sort(F.map_entries("hourly_aircraft_breakdown")), lambda e: e["value"].cast("string"))
    return df.withColumns({
        "frequencies_used": F.array_join("frequencies_used", ","), "hours": F.array_join(hours, ","),
        "details": F.array_join(F.transform("aircraft_details", detail), ";"),
    })


@query("build_controller_summaries", "select * from full_controller_summaries")
def build_controller_summaries(t):
    return session_text(L.build_controller_summaries(t.controllers, t.transceivers, known_sessions(t), NOW)).select(*SESSION_ROW)


_SESSION_DONE = f"c.last_updated <= {E_NOW} and exists (select 1 from done_sessions d where d.callsign = c.callsign and d.logon_time = c.logon_time)"


@query("archive_controllers", f"select c.id, c.callsign, c.logon_time from fx_controllers c where {_SESSION_DONE}")
def archive_controllers(t):
    return L.archive_controllers(t.controllers, done_sessions(t), NOW).select("id", "callsign", "logon_time")


@query("remaining_controllers", f"select c.id, c.callsign, c.logon_time from fx_controllers c where not ({_SESSION_DONE})")
def remaining_controllers(t):
    return L.remaining_controllers(t.controllers, done_sessions(t), NOW).select("id", "callsign", "logon_time")


_SUMMARISED = f"c.last_updated <= {E_NOW} and exists (select 1 from done_sessions d where d.callsign = c.callsign and d.logon_time = c.logon_time and d.cid is not null)"


@query(
    "process_controllers",
    f"""select 'summaries' as part, count(*) as n_rows from merged_sessions
union all select 'archived', count(*) from fx_controllers c where {_SUMMARISED}
union all select 'remaining', count(*) from fx_controllers c where not ({_SUMMARISED})""",
)
def process_controllers(t):
    return L.process_counts(L.process_controllers(t.controllers, t.transceivers, known_sessions(t), NOW))


_CONTROLLER_ROW = "c.id, c.callsign, c.cid, c.name, c.rating, c.frequency, c.logon_time, c.last_updated"


@query(
    "process_controllers_written",
    f"""select 'controllers' as part, {_CONTROLLER_ROW}, {', '.join(f'null as {c}' for c in SESSION_ROW[4:])} from fx_controllers c where not ({_SUMMARISED})
union all select 'controllers_archive', {_CONTROLLER_ROW}, {', '.join('null' for _ in SESSION_ROW[4:])} from fx_controllers c where {_SUMMARISED}
union all select 'controller_summaries', null, callsign, cid, name, rating, null, null, null, {', '.join(SESSION_ROW[4:])} from full_controller_summaries
union all select 'controller_summaries', null, callsign, cid, null, null, null, null, null, session_start_time, session_start_time,
 {', '.join('null' for _ in SESSION_ROW[6:])} from known_sessions""",
)
def process_controllers_written(t):
    """The three tables of a store after a run that was given up, the run, and the run once more."""
    store = shared_folder(t.spark, "store")
    earlier = known_sessions(t).withColumn("session_end_time", F.col("session_start_time"))
    for name, df in (("controllers", t.controllers), ("transceivers", t.transceivers), ("controller_summaries", earlier)):
        L.load_table(df, store, name)
    L.stage_controllers_run(t.spark, store, NOW)  # not published: leaves nothing but files
    for _ in range(2):
        L.process_controllers_written(t.spark, store, NOW)

    def rows(name):
        df = tables.read(t.spark, store, name)
        if name == "controller_summaries":
            df = session_text(df).withColumn("id", F.lit(None).cast("long"))
            # array_join gives the empty text for a list that is not there
            df = df.withColumns({c: F.when(F.col("created_at").isNotNull(), F.col(c)) for c in ("frequencies_used", "hours", "details")})
        columns = ["id", "callsign", "cid", "name", "rating", "frequency", "logon_time", "last_updated", *SESSION_ROW[4:]]
        return df.select(F.lit(name).alias("part"), *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])

    return rows("controller_summaries").unionByName(rows("controllers_archive")).unionByName(rows("controllers"))


# --- archives ---

_FILL = ["time_online_minutes", "total_enroute_time_minutes", "completion_time"]
_GAP = " or ".join(f"a.{c} is null" for c in _FILL)


@query(
    "fill_archive_from_summary",
    f"""select a.id, a.callsign, {', '.join(f'case when s.id is not null and ({_GAP}) then s.{c} else a.{c} end as {c}' for c in _FILL)}
from fx_flights_archive a left join (select * from (select *, row_number() over (partition by {KEY} order by completion_time desc, id desc) as rn
 from fx_flight_summaries) where rn = 1) s on {' and '.join(f'a.{c} = s.{c}' for c in KEY.split(', '))}""",
)
def fill_archive_from_summary(t):
    return L.fill_archive_from_summary(t.flights_archive, t.flight_summaries, _FILL).select("id", "callsign", *_FILL)


@query(
    "sync_archive_columns",
    f"""select a.id, a.callsign, {', '.join(f'coalesce(a.{c}, s.{c}) as {c}' for c in _FILL)} from fx_flights_archive a
left join (select callsign, {', '.join(f"arg_max({c}, struct_pack(a := completion_time, b := id)) filter ({c} is not null) as {c}" for c in _FILL)}
 from fx_flight_summaries group by 1) s on a.callsign = s.callsign""",
)
def sync_archive_columns(t):
    return L.sync_archive_columns(t.flights_archive, t.flight_summaries, _FILL).select("id", "callsign", *_FILL)


@query("archive_retention", f"select id, callsign, last_updated from fx_flights_archive where last_updated >= {O_NOW} - interval 50000 hour")
def archive_retention(t):
    return L.archive_retention(t.flights_archive, ORDERS_NOW, 50000).select("id", "callsign", "last_updated")


# The summaries to fill again: those just built from the stored flights, without contacts.
@query(
    "backfill_contacts",
    f"""select k.callsign, k.departure, k.arrival, k.logon_time, coalesce(c.n, 0) as interactions_detected,
 least(100e0, coalesce({ratio_sql('c.n', 'k.n', 1, 100)}, 0)) as controller_time_percentage
from flight_keys k left join base_contacts c on c.callsign = k.callsign and c.departure = k.departure and c.arrival = k.arrival and c.logon_time = k.logon_time""",
)
def backfill_contacts(t):
    blank = t.flights.groupBy(*L.FLIGHT_KEY).agg(F.min("id").alias("id")).withColumn("controller_callsigns", F.lit("{}"))
    return L.backfill_contacts(blank, t.flights, t.transceivers, t.controllers, window="flight").drop("id", "controller_callsigns")


@query(
    "active_interactions",
    f"""select k.callsign, k.departure, k.arrival, k.logon_time, coalesce(c.n, 0) as interactions_detected
from (select distinct callsign, departure, arrival, logon_time from fx_flights_then where last_updated >= {E_NOW} - interval 180 second
 and departure is not null and arrival is not null) k
left join base_contacts_then c on c.callsign = k.callsign and c.departure = k.departure and c.arrival = k.arrival and c.logon_time = k.logon_time""",
)
def active_interactions(t):
    return L.active_flight_interactions(t.flights, t.transceivers, t.controllers, NOW, window="flight")


@query(
    "active_controller_interactions",
    f"""select s.callsign, s.logon_time, coalesce(a.n, 0) as interactions_detected
from (select distinct callsign, logon_time from fx_controllers_then where last_updated >= {E_NOW} - interval 180 second) s
left join (select s.callsign, s.logon_time, count(distinct f.callsign) as n
 from (select distinct callsign, logon_time from fx_controllers_then where last_updated >= {E_NOW} - interval 180 second) s
 join fx_transceivers_then a on a.entity_type = 'atc' and a.callsign = s.callsign and a.ts between s.logon_time and {E_NOW}
 join fx_transceivers_then f on f.entity_type = 'flight' and f.ts between s.logon_time and {E_NOW}
  and abs(f.frequency - a.frequency) <= 5000 and abs(epoch(f.ts) - epoch(a.ts)) <= 180
 where {NM.format(a='a.position_lat', b='a.position_lon', c='f.position_lat', d='f.position_lon')} <= {LIMIT_CASE.format(c='s.callsign')}
 group by 1, 2) a on a.callsign = s.callsign and a.logon_time = s.logon_time""",
)
def active_controller_interactions(t):
    return L.active_controller_interactions(t.controllers, t.transceivers, NOW)
