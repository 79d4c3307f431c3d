"""Queries of the data quality rules and of the status reports."""

from __future__ import annotations

from airtrace.plans import quality as Q
from airtrace.plans.lifecycle import STORED_TIME, load_table
from airtrace.registry.base import percent_sql, query
from airtrace.registry.derived import AS_OF_EVENTS as NOW
from airtrace.registry.sector_queries import stays
from airtrace.session import shared_folder

E_NOW = f"timestamp '{NOW}'"

_TABLES = {
    "flights": ("fx_flights", {"valid_pilot_rating"}),
    "controllers": ("fx_controllers", {"valid_visual_range"}),
    "transceivers": ("fx_transceivers", set()),
    "controller_summaries": ("fx_controller_summaries", set()),
    "flight_summaries": ("fx_flight_summaries", {"valid_airborne_time", "valid_total_enroute_sectors"}),
    "flight_sector_occupancy": ("stays", set()),
}


def _constraints_sql() -> str:
    parts = []
    for name, (source, skipped) in _TABLES.items():
        for rule, text in Q.RULES[name].items():
            found = f"count(case when not ({text}) then 1 end) as violations from {source}"
            parts.append(f"select '{name}' as table_name, '{rule}' as rule, " + ("null as violations" if rule in skipped else found))
    return "\nunion all ".join(parts)


@query("dq_constraints", _constraints_sql())
def dq_constraints(t):
    return Q.dq_all_constraints(
        {
            "flights": t.flights, "controllers": t.controllers, "transceivers": t.transceivers,
            "controller_summaries": t.controller_summaries, "flight_summaries": t.flight_summaries,
            "flight_sector_occupancy": stays(t),
        }
    )


_FULL = " and ".join(f"{c} is not null" for c in Q.REQUIRED)


@query(
    "dq_completeness",
    f"""select count(*) as total_flights, count(case when {_FULL} then 1 end) as complete_flights,
 {percent_sql(f'count(case when {_FULL} then 1 end)', 'count(*)')} as completeness_rate from fx_flights""",
)
def dq_completeness(t):
    return Q.dq_completeness(t.flights)


_CHECKED = " + ".join(f"count({c})" for c in Q.RANGES)
_VALID = " + ".join(f"count(case when {c} between {a} and {b} then 1 end)" for c, (a, b) in Q.RANGES.items())


@query(
    "dq_position_ranges",
    f"select {_CHECKED} as total_checks, {_VALID} as valid_positions, {percent_sql(_VALID, _CHECKED)} as accuracy_rate from fx_flights",
)
def dq_position_ranges(t):
    return Q.dq_position_ranges(t.flights)


@query(
    "dq_critical_nulls",
    """select 'callsign' as field, count(case when callsign is null or callsign = '' then 1 end) as missing from fx_flights
union all select 'latitude', count(case when latitude is null then 1 end) from fx_flights
union all select 'longitude', count(case when longitude is null then 1 end) from fx_flights""",
)
def dq_critical_nulls(t):
    return Q.dq_critical_nulls(t.flights)


@query(
    "dq_business_rules",
    """select 'blank_callsign' as rule, count(case when coalesce(trim(callsign), '') = '' then 1 end) as violations from fx_flights
union all select 'negative_altitude', count(case when altitude < 0 then 1 end) from fx_flights
union all select 'invalid_rating', count(case when not (rating between 0 and 15) then 1 end) from fx_controllers
union all select 'invalid_cid', count(case when cid <= 0 then 1 end) from fx_controllers""",
)
def dq_business_rules(t):
    return Q.dq_business_rules(t.flights, t.controllers)


# stored minutes moved by 0 to 3, so that some differ by more than one
_OFF = "abs(epoch(session_end_time) - epoch(session_start_time) - session_duration_minutes * 60)"
_SHIFTED = "(select id, callsign, session_start_time, session_end_time, session_duration_minutes + cast(id % 4 as int) as session_duration_minutes from fx_controller_summaries)"


@query(
    "dq_session_duration",
    f"""select id, callsign, session_start_time, session_end_time, (epoch(session_end_time) - epoch(session_start_time)) / 60e0 as actual,
 session_duration_minutes as stored, {_OFF} / 60e0 as difference from {_SHIFTED} where {_OFF} > 60""",
)
def dq_session_duration(t):
    shifted = t.controller_summaries.selectExpr(
        "id", "callsign", "session_start_time", "session_end_time",
        "session_duration_minutes + cast(id % 4 as int) as session_duration_minutes",
    )
    return Q.dq_session_duration(shifted)


_BROKEN = """(select id, case when id % 17 = 0 then '' else callsign end as callsign, case when id % 19 = 0 then null else session_start_time end as session_start_time,
 case when id % 23 = 0 then null else session_duration_minutes end as session_duration_minutes, case when id % 29 = 0 then null else total_aircraft_handled end as total_aircraft_handled,
 peak_aircraft_count + cast(case when id % 31 = 0 then 1 else 0 end as int) as peak_aircraft_count from {source})"""


@query(
    "dq_summary_fields",
    " union all ".join(
        f"select id, '{text}' as issue from {_BROKEN.format(source='fx_controller_summaries')} where {test}"
        for text, test in (
            ("Missing callsign", "callsign is null or callsign = ''"),
            ("Missing session start time", "session_start_time is null"),
            ("Missing session duration", "session_duration_minutes is null"),
            ("Missing aircraft count", "total_aircraft_handled is null"),
            ("Peak count above total count", "total_aircraft_handled <> 0 and peak_aircraft_count > total_aircraft_handled"),
        )
    ),
)
def dq_summary_fields(t):
    broken = t.spark.sql("select * from " + _BROKEN.format(source="{source}"), source=t.controller_summaries)
    return Q.dq_summary_fields(broken)


@query(
    "dq_sessions_per_callsign",
    """select callsign, count(*) over (partition by callsign) as logon_count, logon_time, first_record, last_record,
 (epoch(logon_time) - epoch(lag(logon_time) over (partition by callsign order by logon_time))) / 60e0 as gap_minutes
from (select callsign, logon_time, min(last_updated) as first_record, max(last_updated) as last_record from fx_controllers group by 1, 2)
qualify count(*) over (partition by callsign) >= 3""",
)
def dq_sessions_per_callsign(t):
    return Q.dq_sessions_per_callsign(t.controllers)


# --- status ---

_FRESH = {
    "controllers": ("fx_controllers", "last_updated", 300),
    "flights": ("fx_flights", "last_updated", None),
    "transceivers": ("fx_transceivers", "ts", 300),
    "flight_summaries": ("fx_flight_summaries", "completion_time", 7200),
    "flight_sector_occupancy": ("stays", "entry_timestamp", 3600),
}


def _fresh_sql() -> str:
    rows = []
    for name, (source, time, limit) in _FRESH.items():
        age = f"epoch({E_NOW}) - epoch(max({time}))"
        state = "'fresh'" if limit is None else f"case when {age} < {limit} then 'fresh' else 'stale' end"
        rows.append(
            f"select '{name}' as table_name, max({time}) as last_update, cast({age} as bigint) as age_seconds, {state} as status from {source}"
        )
    return "\nunion all ".join(rows)


def _fresh_tables(t):
    return {
        "controllers": (t.controllers, "last_updated"), "flights": (t.flights, "last_updated"),
        "transceivers": (t.transceivers, "timestamp"), "flight_summaries": (t.flight_summaries, "completion_time"),
        "flight_sector_occupancy": (stays(t), "entry_timestamp"),
    }


@query("freshness", _fresh_sql())
def freshness(t):
    return Q.freshness(_fresh_tables(t), NOW)


@query(
    "freshness_overall",
    f"""select stale_tables, critical_issues, case when critical_issues > 0 then 'critical' when stale_tables > 0 then 'degraded' else 'operational' end as status
from (select count(case when status = 'stale' then 1 end) as stale_tables,
 count(case when table_name in ('controllers', 'flights', 'transceivers') and last_update is null then 1 end) as critical_issues from ({_fresh_sql()}))""",
)
def freshness_overall(t):
    return Q.overall_freshness(Q.freshness(_fresh_tables(t), NOW))


def _fresh_store(t):
    """The tables as a store, whose manifest holds rows and times of every folder."""
    store = shared_folder(t.spark, "fresh")
    for name, (df, _) in _fresh_tables(t).items():
        load_table(df, store, name)
    return store


@query("freshness_stored", _fresh_sql())
def freshness_stored(t):
    return Q.stored_freshness(t.spark, _fresh_store(t), NOW)


def _activity(name: str, source: str, time: str) -> str:
    within = ", ".join(
        f"count(case when {time} >= {E_NOW} - interval {span} then 1 end) as {label}"
        for span, label in (("1 hour", "last_hour"), ("10 minute", "last_10min"), ("1 minute", "last_minute"))
    )
    return f"select '{name}' as table_name, count(*) as total_rows, {within}, max({time}) as most_recent_update from {source}"


@query(
    "recent_activity",
    "\nunion all ".join(
        _activity(n, s, c)
        for n, s, c in (
            ("flights", "fx_flights", "last_updated"), ("controllers", "fx_controllers", "last_updated"),
            ("transceivers", "fx_transceivers", "ts"), ("flight_sector_occupancy", "stays", "entry_timestamp"),
        )
    ),
)
def recent_activity(t):
    return Q.recent_activity(
        {
            "flights": (t.flights, "last_updated"), "controllers": (t.controllers, "last_updated"),
            "transceivers": (t.transceivers, "timestamp"), "flight_sector_occupancy": (stays(t), "entry_timestamp"),
        },
        NOW,
    )


@query(
    "stay_activity",
    f"""select count(*) as total_sector_entries, count(case when exit_timestamp is null then 1 end) as open_sectors, count(exit_timestamp) as closed_sectors,
 count(case when entry_timestamp >= {E_NOW} - interval 1 hour then 1 end) as sectors_last_hour,
 count(case when exit_timestamp >= {E_NOW} - interval 1 hour then 1 end) as recent_sector_exits,
 avg(case when exit_timestamp >= {E_NOW} - interval 1 hour then epoch(exit_timestamp) - epoch(entry_timestamp) end) / 60e0 as avg_duration_minutes from stays""",
)
def stay_activity(t):
    return Q.stay_activity(stays(t), NOW)


@query(
    "recent_flights",
    f"""select callsign, latitude, longitude, altitude, last_updated, (epoch({E_NOW}) - epoch(last_updated)) / 60e0 as minutes_ago from fx_flights
where last_updated >= {E_NOW} - interval 10 minute order by last_updated desc, callsign, latitude nulls first, longitude, altitude limit 5""",
)
def recent_flights(t):
    return Q.recent_list(t.flights, "last_updated", NOW, ["callsign", "latitude", "longitude", "altitude"])


@query(
    "table_counts",
    """select 'flights' as table_name, count(*) as n_rows, true as present, '' as missing_columns from fx_flights
union all select 'controllers', count(*), true, '' from fx_controllers
union all select 'transceivers', count(*), true, '' from fx_transceivers
union all select 'flight_summaries', count(*), true, '' from fx_flight_summaries
union all select 'flights_archive', count(*), true, '' from fx_flights_archive
union all select 'flight_sector_occupancy', count(*), true, '' from stays
union all select 'controller_summaries', count(*), true, '' from fx_controller_summaries
union all select 'controllers_archive', null, false, ''""",
)
def table_counts(t):
    return Q.table_counts(
        {
            "flights": t.flights, "controllers": t.controllers, "transceivers": t.transceivers,
            "flight_summaries": t.flight_summaries, "flights_archive": t.flights_archive,
            "flight_sector_occupancy": stays(t), "controller_summaries": t.controller_summaries,
        }
    )


@query(
    "table_counts_stored",
    """select 'flights' as table_name, count(*) as n_rows, true as present, '' as missing_columns from fx_flights
union all select 'controllers', count(*), true, '' from fx_controllers
union all select 'transceivers', count(*), true, '' from fx_transceivers
union all select 'flight_summaries', count(*), true, '' from fx_flight_summaries
union all select 'flight_sector_occupancy', count(*), true, '' from stays
union all select 'flights_archive', null, false, 'deptime'
union all select 'controller_summaries', null, false, ''
union all select 'controllers_archive', null, false, ''""",
)
def table_counts_stored(t):
    return Q.stored_counts(t.spark, _fresh_store(t))


@query(
    "recent_activity_stored",
    "\nunion all ".join(
        _activity(n, s, c)
        for n, s, c in (
            ("flights", "fx_flights", "last_updated"), ("controllers", "fx_controllers", "last_updated"),
            ("transceivers", "fx_transceivers", "ts"), ("flight_sector_occupancy", "stays", "entry_timestamp"),
        )
    ),
)
def recent_activity_stored(t):
    names = ("flights", "controllers", "transceivers", "flight_sector_occupancy")
    return Q.stored_activity(t.spark, _fresh_store(t), {n: STORED_TIME[n] for n in names}, NOW)
