"""Queries of the radio matching and of the contact reports."""

from __future__ import annotations

from airtrace.plans import contact_reports as R
from airtrace.registry.base import percent_sql, query, shared_cte

shared_cte(
    "atc_rows",
    """select * from fx_transceivers where entity_type = 'atc'
 and callsign in (select callsign from fx_controllers where facility <> 0)""",
)
shared_cte(
    "report_pairs",
    """select ft.id as flight_id, ft.callsign as flight_callsign, ft.ts as flight_time, a.callsign as atc_callsign, a.id as atc_id, a.ts as atc_time
 from fx_transceivers ft join atc_rows a on abs(ft.frequency - a.frequency) <= 5000
  and abs(epoch(ft.ts) - epoch(a.ts)) <= 180
 where ft.entity_type = 'flight'
  and sqrt(pow(ft.position_lat - a.position_lat, 2) + pow(ft.position_lon - a.position_lon, 2)) <= 300""",
)
shared_cte(
    "contact_rows",
    """select * from fx_flights f where exists (select 1 from (select distinct flight_callsign, flight_time from report_pairs) m
 where m.flight_callsign = f.callsign and abs(epoch(f.last_updated) - epoch(m.flight_time)) <= 180)""",
)


def _grouped(group: str, name: str, flights_name: str, extra: str = "", where: str = "") -> str:
    return f"""
select t.{name}{extra}, count(distinct t.callsign) as {flights_name}, cast(sum(t.n) as bigint) as total_flight_data_records,
 cast(sum(coalesce(c.n, 0)) as bigint) as flight_data_records_in_contact_with_atc,
 {percent_sql('sum(coalesce(c.n, 0))', 'sum(t.n)')} as percentage_with_atc
from (select callsign, {group} as {name}, count(*) as n from fx_flights f {where} group by 1, 2) t
left join (select callsign, {group} as {name}, count(*) as n from contact_rows f {where} group by 1, 2) c
 on t.callsign = c.callsign and t.{name} = c.{name}
group by t.{name}"""


@query(
    "overall_atc_statistics",
    f"""select count(*) as total_flights, cast(sum(t.n) as bigint) as total_flight_data_records,
 cast(sum(coalesce(c.n, 0)) as bigint) as flight_data_records_in_contact_with_atc,
 {percent_sql('sum(coalesce(c.n, 0))', 'sum(t.n)')} as percentage_with_atc
from (select callsign, count(*) as n from fx_flights group by 1) t
left join (select callsign, count(*) as n from contact_rows group by 1) c on t.callsign = c.callsign""",
)
def overall_atc_statistics(t):
    return R.overall_atc_statistics(t.flights, t.transceivers, t.controllers)


@query(
    "pct_time_by_aircraft",
    f"""select t.callsign, t.n as total_flight_data_records, coalesce(c.n, 0) as flight_data_records_in_contact_with_atc,
 {percent_sql('coalesce(c.n, 0)', 't.n')} as percentage_with_atc
from (select callsign, count(*) as n from fx_flights group by 1) t
left join (select callsign, count(*) as n from contact_rows group by 1) c on t.callsign = c.callsign""",
)
def pct_time_by_aircraft(t):
    return R.pct_time_by_aircraft(t.flights, t.transceivers, t.controllers)


@query("atc_by_hour", _grouped("cast(hour(f.last_updated) as int)", "hour_of_day", "total_flights_in_hour"))
def atc_by_hour(t):
    return R.atc_by_hour(t.flights, t.transceivers, t.controllers)


@query(
    "atc_by_weekday",
    _grouped(
        "cast(dayofweek(f.last_updated) as int)", "weekday_number", "total_flights_in_weekday",
        extra=", ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][t.weekday_number + 1] as weekday_name",
    ),
)
def atc_by_weekday(t):
    return R.atc_by_weekday(t.flights, t.transceivers, t.controllers)


@query("atc_by_route", _grouped("concat(f.departure, '-', f.arrival)", "route", "total_flights_on_route",
                                where="where f.departure is not null and f.arrival is not null"))
def atc_by_route(t):
    return R.atc_by_route(t.flights, t.transceivers, t.controllers)


POSITION_CASE = (
    "case when {c} like '%FSS%' then 'FSS' when {c} like '%CTR%' then 'CTR' when {c} like '%APP%' then 'APP' "
    "when {c} like '%TWR%' then 'TWR' when {c} like '%GND%' then 'GND' when {c} like '%DEL%' then 'DEL' else 'OTHER' end"
)


def _labelled(label: str, name: str, flights_name: str, extra: str = "") -> str:
    return f"""
select c.{name}{extra}, count(distinct t.callsign) as {flights_name}, cast(sum(t.n) as bigint) as total_flight_data_records,
 cast(sum(coalesce(c.n, 0)) as bigint) as flight_data_records_in_contact_with_atc,
 {percent_sql('sum(coalesce(c.n, 0))', 'sum(t.n)')} as percentage_with_atc
from (select callsign, count(*) as n from fx_flights group by 1) t
left join (
 select f.callsign, w.label as {name}, sum(m.n * w.n) as n
 from fx_flights f
 join (select flight_callsign, flight_time, atc_callsign, count(*) as n from report_pairs group by 1, 2, 3) m
  on m.flight_callsign = f.callsign and abs(epoch(f.last_updated) - epoch(m.flight_time)) <= 180
 join (select callsign, {label} as label, count(*) as n from fx_controllers where facility <> 0 group by 1, 2) w
  on w.callsign = m.atc_callsign
 group by 1, 2) c on t.callsign = c.callsign
group by c.{name}"""


@query("atc_by_position", _labelled(POSITION_CASE.format(c="callsign"), "position_type", "total_flights_with_position"))
def atc_by_position(t):
    return R.atc_by_position(t.flights, t.transceivers, t.controllers)


@query(
    "atc_by_rank",
    _labelled(
        "rating", "controller_rank", "total_flights_with_rank",
        extra=", case c.controller_rank when 1 then 'Observer' when 2 then 'Student' when 3 then 'Student 2' "
        "when 4 then 'Student 3' when 5 then 'Controller' when 6 then 'Controller 2' when 7 then 'Instructor' "
        "when 8 then 'Instructor 2' when 9 then 'Supervisor' when 10 then 'Administrator' else 'Unknown' end as rank_name",
    ),
)
def atc_by_rank(t):
    return R.atc_by_rank(t.flights, t.transceivers, t.controllers)
