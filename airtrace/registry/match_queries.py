"""Queries of the radio matching operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from airtrace.functions.values import at
from airtrace.operators import contacts as C
from airtrace.registry.base import SHARED_CTES, query, ratio_sql, shared_cte
from airtrace.registry.contact_queries import POSITION_CASE
from airtrace.registry.derived import AS_OF_EVENTS as NOW

E_NOW = f"timestamp '{NOW}'"

LIMIT_CASE = (
    "case right({c}, 3) when 'GND' then 15 when 'DEL' then 15 when 'TWR' then 15 when 'APP' then 60 when 'DEP' then 60 "
    "when 'CTR' then 400 when 'FSS' then 1000 else 15 end"
)
NM = (
    "3440.065e0 * acos(least(1e0, greatest(-1e0, sin(radians({a})) * sin(radians({c})) "
    "+ cos(radians({a})) * cos(radians({c})) * cos(radians({b} - {d})))))"
)
TYPE_CASE = (
    "case when {c} like '%CTR%' then 'CTR' when {c} like '%TMA%' then 'TMA' when {c} like '%TWR%' then 'TWR' "
    "when {c} like '%GND%' then 'GND' when {c} like '%DEL%' then 'DEL' when {c} like '%FSS%' then 'FSS' else 'OTHER' end"
)

shared_cte(
    "flight_keys",
    """select callsign, departure, arrival, logon_time, max(last_updated) as flight_end, count(*) as n from fx_flights
where departure is not null and arrival is not null and logon_time is not null group by 1, 2, 3, 4""",
)
shared_cte(
    "seen_atc",
    """select t.*, c.seen_until, h.heard_until from fx_transceivers t join (select callsign, max(last_updated) as seen_until from fx_controllers
 where facility <> 0 group by 1) c on t.callsign = c.callsign
join (select callsign, max(ts) as heard_until from fx_transceivers where entity_type = 'atc' group by 1) h on t.callsign = h.callsign
where t.entity_type = 'atc'""",
)


def _flight_pairs(window: str) -> str:
    return f"""select k.callsign as flight_callsign, k.departure, k.arrival, k.logon_time, a.callsign as atc_callsign, f.frequency,
 f.ts as flight_time, a.ts as atc_time, f.position_lat as flight_lat, f.position_lon as flight_lon, a.position_lat as atc_lat,
 a.position_lon as atc_lon, cast(abs(epoch(f.ts) - epoch(a.ts)) as double) as time_diff_seconds
from flight_keys k join fx_transceivers f on f.callsign = k.callsign and f.entity_type = 'flight' and {window}
join seen_atc a on abs(f.frequency - a.frequency) <= 5000 and abs(epoch(f.ts) - epoch(a.ts)) <= 180
where a.seen_until >= k.logon_time and a.heard_until >= k.logon_time
 and k.logon_time <= (select max(h.ts) from fx_transceivers h where h.entity_type = 'flight' and h.callsign = k.callsign)
 and {NM.format(a='f.position_lat', b='f.position_lon', c='a.position_lat', d='a.position_lon')} <= {LIMIT_CASE.format(c='a.callsign')}"""


# The tables as they were at the report's time, and what is made of them.
for _name, _time in (("fx_flights", "last_updated"), ("fx_transceivers", "ts"), ("fx_controllers", "last_updated")):
    shared_cte(f"{_name}_then", f"select * from {_name} where {_time} <= {E_NOW}")


def then(sql: str) -> str:
    """The same SQL over the tables as they were at the report's time."""
    return re.sub(r"\b(fx_flights|fx_transceivers|fx_controllers|flight_keys|seen_atc|logon_pairs|whole_pairs)\b", r"\1_then", sql)


for _name in ("flight_keys", "seen_atc"):
    shared_cte(f"{_name}_then", then(SHARED_CTES[_name]))
shared_cte("logon_pairs_then", then(_flight_pairs("abs(epoch(f.ts) - epoch(k.logon_time)) <= 180")))
shared_cte("whole_pairs_then", then(_flight_pairs("f.ts between k.logon_time and k.flight_end")))
shared_cte("logon_pairs", _flight_pairs("abs(epoch(f.ts) - epoch(k.logon_time)) <= 180"))
shared_cte("whole_pairs", _flight_pairs("f.ts between k.logon_time and k.flight_end"))


@query("match_flight_atc", "select * from logon_pairs")
def match_flight_atc(t):
    return C.match_flight_atc(t.flights, t.transceivers, t.controllers)


@query("match_flight_atc_whole", "select * from whole_pairs")
def match_flight_atc_whole(t):
    return C.match_flight_atc(t.flights, t.transceivers, t.controllers, window="flight")


shared_cte(
    "ctl_sessions",
    "select callsign, logon_time as session_start, max(last_updated) as session_end from fx_controllers group by 1, 2",
)
shared_cte(
    "session_pairs",
    f"""select s.callsign, s.session_start, s.session_end, f.callsign as flight_callsign, a.frequency, f.ts as flight_time, a.ts as atc_time,
 cast(abs(epoch(f.ts) - epoch(a.ts)) as double) as time_diff_seconds
from ctl_sessions s join fx_transceivers a on a.entity_type = 'atc' and a.callsign = s.callsign and a.ts between s.session_start and s.session_end
join fx_transceivers f on f.entity_type = 'flight' and f.ts between s.session_start and s.session_end
 and abs(f.frequency - a.frequency) <= 5000 and abs(epoch(f.ts) - epoch(a.ts)) <= 180
where {NM.format(a='a.position_lat', b='a.position_lon', c='f.position_lat', d='f.position_lon')} <= {LIMIT_CASE.format(c='s.callsign')}""",
)


def sessions(t):
    return t.controllers.groupBy("callsign", F.col("logon_time").alias("session_start")).agg(
        F.max("last_updated").alias("session_end")
    )


@query("match_controller_flight", "select * from session_pairs")
def match_controller_flight(t):
    return C.match_controller_flight(sessions(t), t.transceivers)


@query(
    "flight_radio_rows",
    f"""select t.id, t.callsign, t.frequency, t.ts as timestamp, k.departure, k.arrival, k.logon_time from flight_keys k
join fx_transceivers t on t.callsign = k.callsign and t.entity_type = 'flight' and t.ts between k.logon_time and {E_NOW}""",
)
def flight_radio_rows(t):
    rows = C.flight_radio_rows(C.flight_keys(t.flights), t.transceivers, at(NOW))
    return rows.select("id", "callsign", "frequency", "timestamp", "departure", "arrival", "logon_time")


# Stored completions: half of the flights, an hour after their log-on; of two summaries the newer one counts.
shared_cte(
    "stored_completions",
    """select callsign, departure, arrival, logon_time, logon_time + interval 60 minute as completion_time from flight_keys
where cast(substr(callsign, 4) as int) % 2 = 0""",
)


@query(
    "flight_radio_rows_completed",
    f"""select t.id, t.callsign, t.frequency, t.ts as timestamp, k.departure, k.arrival, k.logon_time from flight_keys k
left join stored_completions c on c.callsign = k.callsign and c.departure = k.departure and c.arrival = k.arrival and c.logon_time = k.logon_time
join fx_transceivers t on t.callsign = k.callsign and t.entity_type = 'flight' and t.ts between k.logon_time and coalesce(c.completion_time, {E_NOW})""",
)
def flight_radio_rows_completed(t):
    even = t.flights.where(F.substring("callsign", 4, 9).cast("int") % 2 == 0).groupBy(*C.FLIGHT_KEY).agg(F.min("id").alias("id"))
    older = even.withColumn("completion_time", F.col("logon_time") + F.expr("interval 10 minutes"))
    newer = even.withColumns({"id": F.col("id") + 10**9, "completion_time": F.col("logon_time") + F.expr("interval 60 minutes")})
    done = C.flight_completion_time(older.unionByName(newer))
    rows = C.flight_radio_rows(C.flight_keys(t.flights), t.transceivers, at(NOW), done)
    return rows.select("id", "callsign", "frequency", "timestamp", "departure", "arrival", "logon_time")


@query(
    "relevant_atc_rows",
    f"""select id, callsign, frequency, ts as timestamp from fx_transceivers where entity_type = 'atc' and ts >= {E_NOW} - interval 60 minute
 and callsign in (select callsign from fx_controllers where facility <> 0 and last_updated >= {E_NOW} - interval 60 minute)""",
)
def relevant_atc_rows(t):
    since = at(NOW) - F.expr("interval 60 minutes")
    return C.relevant_atc_rows(t.transceivers, t.controllers, since).select("id", "callsign", "frequency", "timestamp")


@query(
    "session_radio_rows",
    """select t.id, t.callsign, t.ts as timestamp, s.session_start, s.session_end from ctl_sessions s
join fx_transceivers t on t.entity_type = 'atc' and t.callsign = s.callsign and t.ts between s.session_start and s.session_end""",
)
def session_radio_rows(t):
    return C.session_radio_rows(sessions(t), t.transceivers).select("id", "callsign", "timestamp", "session_start", "session_end")


@query(
    "session_flight_rows",
    """select s.callsign as session_callsign, s.session_start, count(*) as n_rows from ctl_sessions s
join fx_transceivers t on t.entity_type = 'flight' and t.ts between s.session_start and s.session_end group by 1, 2""",
)
def session_flight_rows(t):
    rows = C.session_radio_rows(sessions(t), t.transceivers, "flight")
    return rows.groupBy("session_callsign", "session_start").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "flight_completion_time",
    """select callsign, departure, arrival, logon_time, completion_time from (select *, row_number() over (
 partition by callsign, departure, arrival, logon_time order by id desc) as rn from fx_flight_summaries where completion_time is not null) where rn = 1""",
)
def flight_completion_time(t):
    return C.flight_completion_time(t.flight_summaries)


@query("report_match_all", "select flight_id, flight_callsign, flight_time, atc_callsign, atc_time from report_pairs")
def report_match_all(t):
    return C.report_match_all(t.transceivers, t.controllers).select(
        F.col("id").alias("flight_id"), "flight_callsign", "flight_time", "atc_callsign", "atc_time"
    )


@query("records_with_contact", "select id, callsign, last_updated from contact_rows")
def records_with_contact(t):
    return C.records_with_contact(t.flights, t.transceivers, t.controllers).select("id", "callsign", "last_updated")


@query(
    "records_by_controller",
    f"""select f.callsign, w.label, cast(sum(m.n * w.n) as bigint) as records from fx_flights f
join (select flight_callsign, flight_time, atc_callsign, count(*) as n from report_pairs group by 1, 2, 3) m
 on m.flight_callsign = f.callsign and abs(epoch(f.last_updated) - epoch(m.flight_time)) <= 180
join (select callsign, {POSITION_CASE.format(c='callsign')} as label, count(*) as n from fx_controllers where facility <> 0 group by 1, 2) w
 on w.callsign = m.atc_callsign group by 1, 2""",
)
def records_by_controller(t):
    from airtrace.functions.callsign import position_type

    return C.records_by_controller(t.flights, t.transceivers, t.controllers, position_type(F.col("callsign")))


@query(
    "join_totals_left",
    """select t.callsign, t.n as total, coalesce(c.n, 0) as contact from (select callsign, count(*) as n from fx_flights group by 1) t
left join (select callsign, count(*) as n from contact_rows group by 1) c on t.callsign = c.callsign""",
)
def join_totals_left(t):
    from airtrace.plans.contact_reports import join_totals_left as join

    totals = t.flights.groupBy("callsign").agg(F.count(F.lit(1)).alias("total"))
    contacts = C.records_with_contact(t.flights, t.transceivers, t.controllers).groupBy("callsign").agg(
        F.count(F.lit(1)).alias("contact")
    )
    return join(totals, contacts, ["callsign"])


shared_cte(
    "flight_contacts",
    f"""select flight_callsign as callsign, departure, arrival, logon_time, atc_callsign, min(flight_time) as first_contact,
 max(flight_time) as last_contact, count(*) as contact_count, {TYPE_CASE.format(c='atc_callsign')} as type
from whole_pairs group by 1, 2, 3, 4, 5""",
)


@query(
    "atc_contact_metrics",
    f"""select c.callsign, c.departure, c.arrival, c.logon_time, cast(c.n as bigint) as interactions_detected, k.n as record_count,
 c.controllers, cast(c.n as double) as total_controller_time_minutes,
 least(100e0, {ratio_sql('c.n', 'k.n', 1, 100)}) as controller_time_percentage,
 least(100e0, {ratio_sql('c.n', 'k.n', 1, 100)}) as airborne_controller_time_percentage
from (select callsign, departure, arrival, logon_time, sum(contact_count) as n,
 string_agg(concat(atc_callsign, '/', type, '/', cast(contact_count as bigint), '/', strftime(first_contact, '%H:%M'), '/', strftime(last_contact, '%H:%M')), ';' order by atc_callsign) as controllers
 from flight_contacts group by 1, 2, 3, 4) c join flight_keys k
on k.callsign = c.callsign and k.departure = c.departure and k.arrival = c.arrival and k.logon_time = c.logon_time""",
)
def atc_contact_metrics(t):
    matches = C.match_flight_atc(t.flights, t.transceivers, t.controllers, window="flight")
    out = C.atc_contact_metrics(matches, t.flights)

    def text(e):
        v = e["value"]
        clock = [F.date_format(v[n], "HH:mm") for n in ("first_contact", "last_contact")]
        return F.concat_ws("/", e["key"], v["type"], v["contact_count"].cast("string"), *clock)

    entries = F.array_sort(F.transform(F.map_entries("controller_callsigns"), text))
    return out.withColumn("controllers", F.array_join(entries, ";")).drop("controller_callsigns")


@query(
    "contacts_per_controller",
    "select *, cast(contact_count as double) as time_minutes from flight_contacts",
)
def contacts_per_controller(t):
    return C.contacts_per_controller(C.match_flight_atc(t.flights, t.transceivers, t.controllers, window="flight"))


@query("flight_record_count", "select callsign, departure, arrival, logon_time, n as record_count from flight_keys")
def flight_record_count(t):
    return C.flight_record_count(t.flights)


shared_cte(
    "session_aircraft",
    """select callsign, session_start, session_end, flight_callsign, min(flight_time) as first_seen, max(flight_time) as last_seen,
 count(*) as updates_count, arg_min(frequency, struct_pack(a := flight_time, b := atc_time, c := frequency)) as frequency
from session_pairs group by 1, 2, 3, 4""",
)


@query(
    "aircraft_metrics",
    """select callsign, session_start, session_end, count(*) as total_aircraft, count(*) as peak_count,
 string_agg(concat(flight_callsign, '/', frequency, '/', strftime(first_seen, '%H:%M'), '/', strftime(last_seen, '%H:%M'), '/',
  cast((epoch(last_seen) - epoch(first_seen)) // 60 as bigint), '/', updates_count), ';' order by flight_callsign) as details
from session_aircraft group by 1, 2, 3""",
)
def aircraft_metrics(t):
    out = C.aircraft_metrics(C.match_controller_flight(sessions(t), t.transceivers))

    def text(d):
        clock = [F.date_format(d[n], "HH:mm") for n in ("first_seen", "last_seen")]
        hz = F.round(d["frequency_mhz"] * 1_000_000).cast("long").cast("string")
        return F.concat_ws(
            "/", d["callsign"], hz, *clock, d["time_on_frequency_minutes"].cast("string"), d["updates_count"].cast("string")
        )

    details = F.array_join(F.transform("aircraft_details", text), ";")
    return out.withColumn("details", details).drop("aircraft_details", "hourly_aircraft_breakdown")


@query(
    "hourly_breakdown",
    """select s.callsign, s.session_start, s.session_end, cast(h.h as int) as hour,
 cast(count(case when h.h between hour(s.first_seen) and hour(s.last_seen) then 1 end) as int) as aircraft
from session_aircraft s, (select unnest(generate_series(0, 23)) as h) h group by 1, 2, 3, 4""",
)
def hourly_breakdown(t):
    aircraft = C.aircraft_per_session(C.match_controller_flight(sessions(t), t.transceivers))
    return C.hourly_breakdown(aircraft).select(
        *C.SESSION_KEY, F.explode("hourly_aircraft_breakdown").alias("hour", "aircraft")
    )
