"""Queries of the specified management reports."""

from __future__ import annotations

from airtrace.plans import requirements as R
from airtrace.registry.base import avg2_sql, avg_sql, percent_sql, query, ratio_sql
from airtrace.registry.derived import AS_OF_ORDERS as ORDERS_NOW

O_NOW = f"timestamp '{ORDERS_NOW}'"
WIDE_DAYS = 900

CONTACT_CASE = (
    "case when upper(k) like '%CTR%' then 'CTR' when upper(k) like '%TMA%' then 'TMA' when upper(k) like '%TWR%' then 'TWR' "
    "when upper(k) like '%GND%' then 'GND' when upper(k) like '%DEL%' then 'DEL' when upper(k) like '%FSS%' then 'FSS' else 'OTHER' end"
)
_KEYS = "(select *, unnest(json_keys(controller_callsigns)) as k from fx_flight_summaries)"


@query(
    "report_ifr_coverage",
    f"""select count(*) as ifr_flights, count(case when controller_time_percentage > 0 then 1 end) as ifr_flights_with_contact,
 {percent_sql('count(case when controller_time_percentage > 0 then 1 end)', 'count(*)')} as ifr_coverage_percentage
from fx_flight_summaries where flight_rules = 'I'""",
)
def report_ifr_coverage(t):
    return R.report_ifr_coverage(t.flight_summaries)


@query(
    "report_interactions_per_ifr",
    f"""select controllers, flights, {ratio_sql('sum(controllers * flights) over ()', 'sum(flights) over ()', 2)} as avg_controllers_per_flight
from (select coalesce(len(json_keys(controller_callsigns)), 0) as controllers, count(*) as flights from fx_flight_summaries
 where flight_rules = 'I' group by 1)""",
)
def report_interactions_per_ifr(t):
    return R.report_interactions_per_ifr(t.flight_summaries)


@query(
    "report_coverage_by_type",
    f"""select controller_type, count(*) as flights, {percent_sql('count(*)', '(select count(*) from fx_flight_summaries)')} as coverage_percentage
from (select distinct id, {CONTACT_CASE} as controller_type from {_KEYS}) group by 1""",
)
def report_coverage_by_type(t):
    return R.report_coverage_by_type(t.flight_summaries)


@query(
    "report_workload",
    f"""select controller_type, contacts, {percent_sql('contacts', 'sum(contacts) over ()')} as workload_percentage
from (select {CONTACT_CASE} as controller_type, count(*) as contacts from {_KEYS} group by 1)""",
)
def report_workload(t):
    return R.report_workload(t.flight_summaries)


@query(
    "report_hourly_traffic",
    f"""select hour, controller_type, count(*) as flights from (
 select id, unnest(generate_series(greatest(date_trunc('hour', logon_time), date_trunc('hour', {O_NOW} - interval {WIDE_DAYS} day)),
  least(date_trunc('hour', completion_time), {O_NOW}), interval 1 hour)) as hour
 from fx_flight_summaries where completion_time >= {O_NOW} - interval {WIDE_DAYS} day and logon_time <= {O_NOW}) h
left join (select distinct id, {CONTACT_CASE} as controller_type from {_KEYS}) k on h.id = k.id group by 1, 2""",
)
def report_hourly_traffic(t):
    return R.report_hourly_traffic(t.flight_summaries, ORDERS_NOW, days=WIDE_DAYS)


def _peak(kind: str, source: str) -> str:
    return f"""(select '{kind}' as kind, level as peak, make_timestamp(cast(s * 1000000 as bigint)) as peak_time from (
 select s, cast(sum(sum(d)) over (order by s) as bigint) as level from (
  select cast(epoch(a) as bigint) as s, 1 as d from {source} union all select cast(epoch(b) as bigint) + 1, -1 from {source}) group by s)
order by level desc, s limit 1)"""


_SPANS = "(select logon_time as a, completion_time as b from fx_flight_summaries where flight_rules = 'I' and logon_time <= completion_time)"
_SESSIONS = (
    "(select session_start_time as a, session_end_time as b from fx_controller_summaries "
    "where (callsign like '%CTR' or callsign like '%FSS') and session_start_time <= session_end_time)"
)


@query("report_peak_load", f"select * from {_peak('ifr_flights', _SPANS)} union all select * from {_peak('enroute_controllers', _SESSIONS)}")
def report_peak_load(t):
    return R.report_peak_load(t.flight_summaries, t.controller_summaries)


@query(
    "report_aircraft_mix",
    f"""select aircraft_type, count(*) as flights, {avg_sql('time_online_minutes')} as avg_duration_minutes
from fx_flight_summaries where aircraft_type <> '' group by 1""",
)
def report_aircraft_mix(t):
    return R.report_aircraft_mix(t.flight_summaries)


@query(
    "report_route_performance",
    f"""select departure, arrival, count(*) as flights, {avg2_sql('controller_time_percentage')} as avg_coverage_percentage
from fx_flight_summaries where departure <> '' and arrival <> '' group by 1, 2 order by 3 desc, 1, 2 limit 10""",
)
def report_route_performance(t):
    return R.report_route_performance(t.flight_summaries)


@query(
    "report_flow",
    "select departure, arrival, count(*) as flights from fx_flight_summaries where departure <> '' and arrival <> '' group by 1, 2",
)
def report_flow(t):
    return R.report_flow(t.flight_summaries)


_MINUTES = "time_online_minutes"


@query(
    "report_ifr_duration",
    f"""select count(*) as flights, {avg_sql(_MINUTES)} as mean_minutes, quantile_cont({_MINUTES}, 0.5) as median_minutes,
 count(case when {_MINUTES} < 60 then 1 end) as under_1h, count(case when {_MINUTES} >= 60 and {_MINUTES} < 120 then 1 end) as from_1h,
 count(case when {_MINUTES} >= 120 and {_MINUTES} < 240 then 1 end) as from_2h,
 count(case when {_MINUTES} >= 240 and {_MINUTES} < 480 then 1 end) as from_4h, count(case when {_MINUTES} >= 480 then 1 end) as from_8h
from fx_flight_summaries where flight_rules = 'I' and {_MINUTES} is not null""",
)
def report_ifr_duration(t):
    return R.report_ifr_duration(t.flight_summaries)


@query(
    "report_airborne_contact",
    f"""select count(*) as total_flights, cast(sum(t.n) as bigint) as total_flight_data_records,
 cast(sum(coalesce(c.n, 0)) as bigint) as flight_data_records_in_contact_with_atc,
 {percent_sql('sum(coalesce(c.n, 0))', 'sum(t.n)')} as percentage_with_atc
from (select callsign, count(*) as n from fx_flights where altitude > 1500 group by 1) t
left join (select callsign, count(*) as n from contact_rows where altitude > 1500 group by 1) c on t.callsign = c.callsign""",
)
def report_airborne_contact(t):
    return R.report_airborne_contact(t.flights, t.transceivers, t.controllers)


@query(
    "report_system_kpis",
    f"""select count(*) as total_flights,
 {percent_sql("count(case when completion_time is not null and arrival <> '' then 1 end)", 'count(*)')} as completion_rate,
 {avg2_sql('controller_time_percentage', 2)} as avg_coverage_percentage, {avg_sql(_MINUTES)} as avg_duration_minutes
from fx_flight_summaries""",
)
def report_system_kpis(t):
    return R.report_system_kpis(t.flight_summaries)
