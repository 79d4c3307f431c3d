"""Queries over controller rows and controller summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtrace.functions.values import at
from airtrace.plans import controller_reports as R
from airtrace.plans.lifecycle import load_table
from airtrace.registry.base import avg_sql, query, ratio_sql, shared_cte
from airtrace.registry.derived import AS_OF_EVENTS as NOW, AS_OF_ORDERS as ORDERS_NOW
from airtrace.session import shared_folder

E_NOW = f"timestamp '{NOW}'"
O_NOW = f"timestamp '{ORDERS_NOW}'"
WIDE_MONTHS, WIDE_WEEKS, WIDE_DAYS = 80, 150, 900

SESSION_COLUMNS = "id, callsign, cid, name, session_start_time, session_end_time, session_duration_minutes, total_aircraft_handled"


@query(
    "list_controller_summaries",
    f"""select {SESSION_COLUMNS} from fx_controller_summaries where callsign ilike '%stn4%'
 and session_start_time >= timestamp '1995-01-01 00:00:00' and session_end_time <= {O_NOW}
order by session_start_time desc, id limit 50 offset 10""",
)
def list_controller_summaries(t):
    out = R.list_controller_summaries(
        t.controller_summaries, "stn4", at("1995-01-01 00:00:00"), at(ORDERS_NOW), limit=50, offset=10
    )
    return out.select(*SESSION_COLUMNS.split(", "))


@query(
    "paging",
    f"""select {SESSION_COLUMNS} from fx_controller_summaries
order by total_aircraft_handled desc, id limit 25 offset 75""",
)
def paging(t):
    from airtrace.sources.adhoc import page

    rows = t.controller_summaries.select(*SESSION_COLUMNS.split(", "))
    return page(rows, [F.desc("total_aircraft_handled"), F.asc("id")], 25, 75)


@query(
    "controller_stats",
    """select callsign, count(*) as total_sessions, coalesce(avg(session_duration_minutes), 0) as avg_session_duration_minutes,
 cast(coalesce(sum(total_aircraft_handled), 0) as bigint) as total_aircraft_handled, coalesce(max(peak_aircraft_count), 0) as max_peak_aircraft,
 min(session_start_time) as first_session, max(session_start_time) as last_session from fx_controller_summaries group by 1""",
)
def controller_stats(t):
    return R.controller_stats(t.controller_summaries)


@query(
    "performance_overview",
    """select count(*) as total_summaries, avg(session_duration_minutes) as avg_session_duration_minutes,
 cast(sum(total_aircraft_handled) as bigint) as total_aircraft_handled, avg(total_aircraft_handled) as avg_aircraft_per_session,
 max(peak_aircraft_count) as max_peak_aircraft, count(distinct callsign) as unique_controllers,
 min(session_start_time) as earliest_session, max(session_start_time) as latest_session from fx_controller_summaries""",
)
def performance_overview(t):
    return R.performance_overview(t.controller_summaries)


@query(
    "dashboard_recent",
    """select callsign, session_start_time as session_start, session_duration_minutes as duration_minutes,
 total_aircraft_handled as aircraft_handled, peak_aircraft_count as peak_aircraft
from fx_controller_summaries order by session_start_time desc, id limit 10""",
)
def dashboard_recent(t):
    return R.dashboard_recent(t.controller_summaries)


@query(
    "dashboard_top",
    """select callsign, count(*) as sessions, cast(sum(total_aircraft_handled) as bigint) as total_aircraft,
 avg(session_duration_minutes) as avg_duration_minutes from fx_controller_summaries group by 1 order by 3 desc, 1 limit 5""",
)
def dashboard_top(t):
    return R.dashboard_top(t.controller_summaries)


@query(
    "positions_by_cid",
    f"""select cid, callsign, facility, logon_time from (select *, row_number() over (partition by callsign order by last_updated desc, id desc) as rn
 from fx_controllers where last_updated between {E_NOW} - interval 24 hour and {E_NOW}) where rn = 1""",
)
def positions_by_cid(t):
    grouped = R.positions_by_cid(t.controllers, NOW)
    return grouped.select("cid", F.explode("positions").alias("p")).select("cid", "p.*")


# --- weekly statistics ---

shared_cte(
    "weekly",
    f"""select k as controller_callsign, count(distinct callsign) as unique_flights_handled, max(completion_time) as last_flight_time,
 count(*) as total_interactions
from (select callsign, completion_time, unnest(json_keys(controller_callsigns)) as k from fx_flight_summaries
 where completion_time >= {O_NOW} - interval {WIDE_DAYS} day and controller_callsigns is not null and controller_callsigns <> '{{}}')
group by 1""",
)


def _weekly(t):
    return R.controller_weekly_stats(t.flight_summaries, ORDERS_NOW, days=WIDE_DAYS)


@query("controller_weekly_stats", "select * from weekly")
def controller_weekly_stats(t):
    return _weekly(t)


@query(
    "flights_per_controller",
    f"""select c.callsign, c.name, c.rating, coalesce(w.n, 0) as unique_flights_handled
from fx_controllers c left join (select k, count(distinct callsign) as n from (select callsign, unnest(json_keys(controller_callsigns)) as k
 from fx_flight_summaries where completion_time >= {O_NOW} - interval 7 day) group by 1) w on c.callsign = w.k
where c.last_updated >= {E_NOW} - interval 7 day and c.rating in (2, 3)""",
)
def flights_per_controller(t):
    return R.flights_per_controller(t.controllers, t.flight_summaries, NOW, ORDERS_NOW)


@query(
    "controller_weekly_join",
    f"""select c.callsign, c.name, c.rating, coalesce(w.unique_flights_handled, 0) as weekly_flights,
 coalesce(w.total_interactions, 0) as weekly_interactions, w.last_flight_time
from fx_controllers c left join weekly w on c.callsign = w.controller_callsign where c.last_updated >= {E_NOW} - interval 7 day""",
)
def controller_weekly_join(t):
    return R.controller_weekly_join(t.controllers, _weekly(t), NOW)


def _stored_weekly(t):
    """Summaries stored in two runs; the second refresh computes the days of the second run only."""
    store = shared_folder(t.spark, "weekly")
    late = F.pmod("id", F.lit(5)) == 0
    for run, rows in (("first", t.flight_summaries.where(~late)), ("second", t.flight_summaries.where(late))):
        load_table(rows, store, "flight_summaries", run)
        R.refresh_day_states(t.spark, store)
    return R.controller_weekly_stored(t.spark, store, ORDERS_NOW, days=WIDE_DAYS)


@query("controller_weekly_stored", "select * from weekly")
def controller_weekly_stored(t):
    return _stored_weekly(t)


@query(
    "controllers_no_activity",
    f"""select c.callsign, c.name, c.rating from fx_controllers c left join weekly w on c.callsign = w.controller_callsign
where c.last_updated >= {E_NOW} - interval 7 day and (w.unique_flights_handled is null or w.unique_flights_handled = 0)""",
)
def controllers_no_activity(t):
    return R.controllers_no_activity(t.controllers, _weekly(t), NOW)


@query(
    "flights_per_controller_radio",
    f"""select c.callsign, c.name, c.rating, count(distinct x.callsign) as unique_flights_handled
from (select distinct callsign, name, rating from fx_controllers where last_updated >= {E_NOW} - interval 7 day and rating in (2, 3)) c
join (select distinct callsign, frequency from fx_transceivers where entity_type = 'atc') a on a.callsign = c.callsign
join (select distinct callsign, frequency from fx_transceivers where entity_type = 'flight') x on x.frequency = a.frequency
where x.callsign in (select callsign from fx_flights where last_updated >= {E_NOW} - interval 7 day)
group by 1, 2, 3 order by 4 desc, 1, 2, 3 limit 5""",
)
def flights_per_controller_radio(t):
    return R.flights_per_controller_radio(t.controllers, t.flights, t.transceivers, NOW)


# --- sessions ---


@query(
    "controllers_by_rank_group",
    f"""select case when rating = 1 then 'Rank 1' when rating = 2 then 'S1' when rating = 3 then 'S2' when rating = 4 then 'S3'
 when rating >= 5 then 'C1+' else 'Unknown' end as rank_group, count(distinct name) as unique_controllers
from fx_controller_summaries where session_start_time >= {O_NOW} - interval {WIDE_WEEKS * 7} day and total_aircraft_handled > 0 group by 1""",
)
def controllers_by_rank_group(t):
    return R.controllers_by_rank_group(t.controller_summaries, ORDERS_NOW, weeks=WIDE_WEEKS)


def _session_stats(case: str, where: str = "") -> str:
    return f"""select {case} as controller_type, count(*) as total_sessions, {avg_sql('session_duration_minutes')} as avg_session_duration_minutes,
 min(session_duration_minutes) as shortest_session_minutes, max(session_duration_minutes) as longest_session_minutes,
 round(stddev_samp(session_duration_minutes), 1) as std_dev_minutes, {avg_sql('total_aircraft_handled')} as avg_aircraft_handled,
 min(total_aircraft_handled) as min_aircraft_handled, max(total_aircraft_handled) as max_aircraft_handled,
 {avg_sql('peak_aircraft_count')} as avg_peak_aircraft,
 round(avg(total_aircraft_handled / nullif(session_duration_minutes // 60, 0)), 1) as avg_efficiency_aircraft_per_hour
from fx_controller_summaries where session_duration_minutes > 0 and session_start_time >= {O_NOW} - interval {WIDE_MONTHS} month{where} group by 1"""


_TYPE = (
    "case when callsign like '%GND%' then 'GND' when callsign like '%TWR%' then 'TWR' when callsign like '%APP%' then 'APP' "
    "when callsign like '%CTR%' then 'CTR' when callsign like '%FSS%' then 'FSS' when callsign like '%DEL%' then 'DEL' else 'OTHER' end"
)


@query("session_stats_by_type", _session_stats(_TYPE))
def session_stats_by_type(t):
    return R.session_stats_by_type(t.controller_summaries, ORDERS_NOW, months=WIDE_MONTHS)


@query(
    "session_stats_fss_ctr",
    _session_stats(
        "case when callsign like '%FSS%' then 'FSS' when callsign like '%CTR%' then 'CTR' else 'OTHER' end",
        " and (callsign like '%FSS%' or callsign like '%CTR%')",
    ),
)
def session_stats_fss_ctr(t):
    return R.session_stats_by_type(t.controller_summaries, ORDERS_NOW, months=WIDE_MONTHS, fss_ctr_only=True)


def _longest(where: str) -> str:
    return f"""select row_number() over (order by session_duration_minutes desc, id) as duration_rank, callsign, name as controller_name, cid, rating, facility,
 session_start_time, session_end_time, session_duration_minutes, total_aircraft_handled, peak_aircraft_count,
 {ratio_sql('total_aircraft_handled', 'nullif(session_duration_minutes // 60, 0)', 1)} as avg_aircraft_per_hour, aircraft_details
from fx_controller_summaries where session_duration_minutes > 0 and ({where}) order by session_duration_minutes desc, id limit 20"""


@query("longest_sessions", _longest(f"session_start_time >= {O_NOW} - interval {WIDE_MONTHS} month"))
def longest_sessions(t):
    return R.longest_sessions(t.controller_summaries, ORDERS_NOW, months=WIDE_MONTHS)


@query(
    "longest_fss_ctr",
    _longest(
        "callsign like '%FSS%' or callsign like '%CTR%' and session_duration_minutes > 0 "
        f"and session_start_time >= {O_NOW} - interval {WIDE_MONTHS} month"
    ),
)
def longest_fss_ctr(t):
    return R.longest_fss_ctr(t.controller_summaries, ORDERS_NOW, months=WIDE_MONTHS)


@query(
    "topk_sessions_r1to3",
    """select callsign as controller_callsign, name as controller_name, total_aircraft_handled as unique_flights_handled,
 session_duration_minutes, session_start_time from fx_controller_summaries where rating in (1, 2, 3) and total_aircraft_handled > 0
order by total_aircraft_handled desc, id limit 5""",
)
def topk_sessions_r1to3(t):
    return R.topk_sessions_r1to3(t.controller_summaries)


def _by_name(where: str) -> str:
    return f"""select name as controller_name, cast(sum(total_aircraft_handled) as bigint) as total_flights_handled, count(*) as total_sessions,
 avg(session_duration_minutes) as avg_session_duration_minutes from fx_controller_summaries
where total_aircraft_handled > 0 and {where} group by 1 order by 2 desc, 1 limit 5"""


@query("topk_r5plus_sessions", _by_name("rating >= 5"))
def topk_r5plus_sessions(t):
    return R.topk_r5plus_sessions(t.controller_summaries)


@query("topk_ctr_fss", _by_name("(callsign like '%CTR' or callsign like '%FSS')"))
def topk_ctr_fss(t):
    return R.topk_ctr_fss(t.controller_summaries)


@query(
    "topk_r1to3_hours",
    f"""select name as controller_name, {ratio_sql('sum(session_duration_minutes)', '60', 0)} as total_time_online_hours, count(*) as total_sessions,
 {avg_sql('total_aircraft_handled', 0)} as avg_aircraft_per_session from fx_controller_summaries
where rating in (1, 2, 3) and total_aircraft_handled > 0 group by 1 order by 2 desc, 1 limit 5""",
)
def topk_r1to3_hours(t):
    return R.topk_r1to3_hours(t.controller_summaries)


@query(
    "topk_r5to12_flights",
    f"""select name as controller_name, rating as controller_rating, cast(sum(total_aircraft_handled) as bigint) as total_flights_handled,
 count(*) as total_sessions from fx_controller_summaries where session_start_time >= {O_NOW} - interval {WIDE_WEEKS * 7} day
 and rating between 5 and 12 and total_aircraft_handled > 0 group by 1, 2 order by 3 desc, 1, 2 limit 10""",
)
def topk_r5to12_flights(t):
    return R.topk_r5to12_flights(t.controller_summaries, ORDERS_NOW, weeks=WIDE_WEEKS)


@query(
    "integrity_statistics",
    """select count(*) as total_summaries, count(distinct callsign) as unique_controllers, avg(session_duration_minutes) as avg_duration,
 min(session_duration_minutes) as min_duration, max(session_duration_minutes) as max_duration, avg(total_aircraft_handled) as avg_aircraft,
 cast(sum(total_aircraft_handled) as bigint) as total_aircraft_handled from fx_controller_summaries""",
)
def integrity_statistics(t):
    return R.integrity_statistics(t.controller_summaries)
