"""Queries that compare summaries, archives, radios and stays."""

from __future__ import annotations

from airtrace.operators.contacts import relevant_atc_rows
from airtrace.plans import integrity as I
from airtrace.registry.base import percent_sql, query
from airtrace.registry.derived import AS_OF_ORDERS as ORDERS_NOW

O_NOW = f"timestamp '{ORDERS_NOW}'"
START, END = "1994-01-01 00:00:00", "1996-01-01 00:00:00"
_FROM, _TO = f"timestamp '{START}'", f"timestamp '{END}'"

_FLIGHT_REFS = f"""(select id as flight_summary_id, callsign as flight_callsign, logon_time, coalesce(completion_time, {O_NOW}) as completion_time,
 unnest(json_keys(controller_callsigns)) as controller_callsign from fx_flight_summaries
 where logon_time <= {_TO} and coalesce(completion_time, {O_NOW}) >= {_FROM})"""
_SESSION_REFS = f"""(select id as controller_summary_id, callsign as controller_callsign, session_start_time,
 coalesce(session_end_time, {O_NOW}) as session_end_time, unnest(json_extract_string(aircraft_details, '$[*].callsign')) as flight_callsign
 from fx_controller_summaries where session_start_time <= {_TO} and coalesce(session_end_time, {O_NOW}) >= {_FROM})"""


@query(
    "integrity_flight_to_controller",
    f"""select fc.* from {_FLIGHT_REFS} fc where not exists (
 select 1 from (select callsign, session_start_time, session_end_time, unnest(json_extract_string(aircraft_details, '$[*].callsign')) as seen
  from fx_controller_summaries) cs
 where cs.callsign = fc.controller_callsign and cs.seen = fc.flight_callsign
  and cs.session_start_time <= fc.completion_time and (cs.session_end_time is null or cs.session_end_time >= fc.logon_time))""",
)
def integrity_flight_to_controller(t):
    return I.integrity_flight_to_controller(t.flight_summaries, t.controller_summaries, START, END, ORDERS_NOW)


@query(
    "integrity_controller_to_flight",
    f"""select cf.* from {_SESSION_REFS} cf left join fx_flight_summaries fs on fs.callsign = cf.flight_callsign
 and fs.logon_time <= cf.session_end_time and coalesce(fs.completion_time, {O_NOW}) >= cf.session_start_time
where fs.id is null or fs.controller_callsigns is null or fs.controller_callsigns = '{{}}'
 or not list_contains(json_keys(fs.controller_callsigns), cf.controller_callsign)""",
)
def integrity_controller_to_flight(t):
    return I.integrity_controller_to_flight(t.flight_summaries, t.controller_summaries, START, END, ORDERS_NOW)


@query(
    "archive_vs_summary",
    """select ca.id, ca.callsign, ca.logon_time, ca.cid, ca.rating, cs.session_start_time, cs.session_duration_minutes, cs.total_aircraft_handled
from fx_controllers_archive ca left join fx_controller_summaries cs on ca.callsign = cs.callsign and ca.logon_time = cs.session_start_time
where ca.logon_time is not null""",
)
def archive_vs_summary(t):
    return I.archive_vs_summary(t.controllers_archive, t.controller_summaries).drop("last_updated")


@query(
    "session_set_diff",
    """select callsign, logon_time as session_start, 'missing_summary' as side from
 (select distinct callsign, logon_time from fx_controllers_archive except select callsign, session_start_time from fx_controller_summaries)
union all
select callsign, session_start_time, 'extra_summary' from
 (select distinct callsign, session_start_time from fx_controller_summaries except select callsign, logon_time from fx_controllers_archive)""",
)
def session_set_diff(t):
    return I.session_set_diff(t.controllers_archive, t.controller_summaries)


@query(
    "coverage_set_diff",
    f"""select count(a.callsign) as callsigns_a, count(b.callsign) as callsigns_b,
 count(case when a.callsign is not null and b.callsign is not null then 1 end) as common,
 count(case when b.callsign is null then 1 end) as missing_in_b, count(case when a.callsign is null then 1 end) as extra_in_b,
 {percent_sql('count(case when a.callsign is not null and b.callsign is not null then 1 end)', 'count(a.callsign)', 1)} as coverage_percent
from (select distinct callsign from fx_transceivers where entity_type = 'atc') a
full join (select distinct callsign from atc_rows) b on a.callsign = b.callsign""",
)
def coverage_set_diff(t):
    plan_a = t.transceivers.where("entity_type = 'atc'")
    return I.coverage_set_diff(plan_a, relevant_atc_rows(t.transceivers, t.controllers))


@query(
    "join_vs_semi_audit",
    """select (select count(*) from fx_transceivers t join fx_controllers c on t.callsign = c.callsign where t.entity_type = 'atc' and c.facility <> 0) as join_rows,
 count(*) as semi_rows, count(distinct callsign) as callsigns, count(distinct frequency) as frequencies,
 count(distinct concat(callsign, '/', frequency)) as callsign_frequencies from atc_rows""",
)
def join_vs_semi_audit(t):
    return I.join_vs_semi_audit(t.transceivers, t.controllers)


@query(
    "match_exact_frequency",
    """select count(*) as matches from fx_transceivers ft join atc_rows a on ft.frequency = a.frequency and abs(epoch(ft.ts) - epoch(a.ts)) <= 180
where ft.entity_type = 'flight'
 and sqrt(pow(ft.position_lat - a.position_lat, 2) + pow(ft.position_lon - a.position_lon, 2)) <= 300""",
)
def match_exact_frequency(t):
    return I.match_exact_frequency(t.transceivers, t.controllers)
