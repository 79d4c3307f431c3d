"""Queries over stored positions and flight summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtrace.functions.aircraft import CATEGORY_RULES, OTHER_CATEGORY, SPEED_EXCLUDED, SPEED_EXCLUDED_PREFIXES
from airtrace.functions.values import at, upto
from airtrace.plans import flight_reports as R
from airtrace.registry.base import avg2_sql, avg_sql, percent_sql, query, ratio_sql, shared_cte
from airtrace.registry.derived import AS_OF_EVENTS as NOW, AS_OF_ORDERS as ORDERS_NOW
from airtrace.session import shared_folder
from airtrace.sources import tables

E_NOW = f"timestamp '{NOW}'"
O_NOW = f"timestamp '{ORDERS_NOW}'"
# wide windows keep rows at every scale
WIDE_DAYS, WIDE_MONTHS, WIDE_WEEKS = 900, 80, 150

# --- stored positions ---


@query(
    "flight_analytics_24h",
    f"""select count(distinct callsign) as flights, count(*) as positions, coalesce(avg(groundspeed), 0) as avg_speed,
 coalesce(max(altitude), 0) as max_alt, count(distinct departure) as departures, count(distinct arrival) as arrivals
from fx_flights where last_updated >= {E_NOW} - interval 24 hour""",
)
def flight_analytics_24h(t):
    return R.flight_analytics_24h(t.flights, NOW)


@query(
    "flight_stats",
    """select callsign, count(*) as position_updates, coalesce(avg(groundspeed), 0) as average_groundspeed,
 coalesce(max(altitude), 0) as max_altitude,
 cast((epoch(max(last_updated)) - epoch(min(last_updated))) // 60 as bigint) as flight_time_minutes
from fx_flights group by callsign""",
)
def flight_stats(t):
    return R.flight_stats(t.flights)


@query(
    "flight_track",
    f"""select callsign, id, last_updated as timestamp, latitude, longitude, altitude, groundspeed from fx_flights
where callsign = 'FLT7' and last_updated between timestamp '2024-01-01 00:10:00' and {E_NOW}""",
)
def flight_track(t):
    return R.flight_track(t.flights, "FLT7", at("2024-01-01 00:10:00"), at(NOW))


@query(
    "flight_track_summary",
    """select callsign, count(*) as total_points,
 cast((epoch(max(last_updated)) - epoch(min(last_updated))) // 60 as bigint) as flight_duration_minutes
from fx_flights where callsign = 'FLT7' group by 1""",
)
def flight_track_summary(t):
    return R.flight_track_summary(t.flights, "FLT7")


def _newest(table: str, columns: list[str], time: str, where: str = "true") -> str:
    return f"""select {', '.join(columns)} from (select *, row_number() over (partition by callsign order by {time} desc, id desc) as rn
 from {table} where {where}) where rn = 1"""


@query("latest_flights", _newest("fx_flights", R.FLIGHT_COLUMNS, "last_updated", f"last_updated between {E_NOW} - interval 30 minute and {E_NOW}"))
def latest_flights(t):
    return R.latest_flights(t.flights, NOW)


@query("latest_flights_kept", _newest("fx_flights", R.FLIGHT_COLUMNS, "last_updated", f"last_updated between {E_NOW} - interval 30 minute and {E_NOW}"))
def latest_flights_kept(t):
    """From a kept table of newest rows, which five batches in no order of time have brought up to date."""
    store = shared_folder(t.spark, "newest")
    rows = upto(t.flights, "last_updated", NOW)
    for i in range(5):
        batch = rows.where(F.pmod(F.xxhash64("id"), F.lit(5)) == i)
        tables.upsert_newest(batch, store, "newest_flights", "callsign", "last_updated", f"batch-{i}")
    return R.latest_flights(tables.read(t.spark, store, "newest_flights"), NOW)


@query("latest_flight", _newest("fx_flights", R.FLIGHT_COLUMNS, "last_updated", "callsign = 'FLT11'"))
def latest_flight(t):
    return R.latest_flight(t.flights, "FLT11")


@query("latest_controllers", _newest("fx_controllers", R.CONTROLLER_COLUMNS, "last_updated", f"last_updated between {E_NOW} - interval 30 minute and {E_NOW}"))
def latest_controllers(t):
    return R.latest_controllers(t.controllers, NOW)


@query(
    "latest_transceivers",
    _newest(
        "(select *, ts as timestamp from fx_transceivers)", R.RADIO_COLUMNS, "ts", f"ts between {E_NOW} - interval 5 minute and {E_NOW}"
    ),
)
def latest_transceivers(t):
    return R.latest_transceivers(t.transceivers, NOW)


@query(
    "latest_rows",
    """select id, callsign, groundspeed, last_updated, strftime(last_updated, '%H:%M:%S') as clock from fx_flights
order by last_updated desc, id desc limit 20""",
)
def latest_rows(t):
    rows = t.flights.select("id", "callsign", "groundspeed", "last_updated")
    return R.latest_rows(rows, "last_updated")


_EXCLUDED = ", ".join(f"'{x}'" for x in SPEED_EXCLUDED)
_PREFIXES = " ".join(f"and aircraft_type not like '{x}%'" for x in SPEED_EXCLUDED_PREFIXES)


@query(
    "top_groundspeed",
    f"""select callsign, name as pilot_name, aircraft_type, departure, arrival, groundspeed as peak_speed_knots,
 altitude as altitude_feet, last_updated as peak_time
from (select *, row_number() over (partition by callsign order by groundspeed desc, id) as rn from fx_flights
 where groundspeed > 100 and groundspeed <= 750 and altitude > 1000 and last_updated >= {E_NOW} - interval 1 month
 and arrival is not null and arrival <> '' and aircraft_type not in ({_EXCLUDED}) {_PREFIXES}) where rn = 1
order by groundspeed desc, callsign limit 20""",
)
def top_groundspeed(t):
    return R.top_groundspeed(t.flights, NOW)


@query(
    "flights_daily_activity",
    f"""select count(*) as total_flights, count(distinct callsign) as unique_callsigns,
 count(distinct cast(last_updated as date)) as active_days from fx_flights where last_updated >= {E_NOW} - interval 24 hour""",
)
def flights_daily_activity(t):
    return R.flights_daily_activity(t.flights, NOW)


# --- regions and origins ---

_REGION = "substring(name, length(name) - 3, 1)"
_REGION_CASE = (
    f"case when {_REGION} in ('L','E') then 'Europe' when {_REGION} in ('V','W') then 'S & SE Asia' "
    f"when {_REGION} = 'R' then 'East Asia' when {_REGION} = 'Y' then 'Australia' when {_REGION} = 'K' then 'United States' "
    f"when {_REGION} = 'Z' then 'China' when {_REGION} = 'N' then 'NZ & Oceania' end"
)


def _regions(table: str, since: str, n: int) -> str:
    return f"""select {_REGION_CASE} as region_name, count(distinct cid) as unique_pilots from {table}
where length(name) >= 4 and {since} and {_REGION} in ('L','E','V','W','R','Y','K','Z','N')
group by 1 order by 2 desc, 1 limit {n}"""


@query("pilot_regions_online", _regions("fx_flights", f"last_updated >= {E_NOW} - interval 1 month", 6))
def pilot_regions_online(t):
    return R.pilot_regions(t.flights, "last_updated", NOW, 6)


@query("pilot_regions_completed", _regions("fx_flight_summaries", f"completion_time >= {O_NOW} - interval 1 month", 10))
def pilot_regions_completed(t):
    return R.pilot_regions(t.flight_summaries, "completion_time", ORDERS_NOW, 10)


# The airport list is derived from the nations; some codes appear several times.
shared_cte(
    "airports",
    """select case when n_nationkey % 4 = 0 then 'YSSY' when n_nationkey % 4 = 1 then 'YBBN' else concat('YB', lpad(cast(n_nationkey as varchar(4)), 2, '0')) end as icao_code,
 concat('State ', n_regionkey) as state, n_name as municipality from nation""",
)


def _airports(t):
    k = F.col("n_nationkey")
    code = F.when(k % 4 == 0, "YSSY").when(k % 4 == 1, "YBBN").otherwise(
        F.concat(F.lit("YB"), F.lpad(k.cast("string"), 2, "0"))
    )
    return t.table("nation").select(
        code.alias("icao_code"),
        F.concat(F.lit("State "), F.col("n_regionkey").cast("string")).alias("state"),
        F.col("n_name").alias("municipality"),
    )


@query(
    "join_airport_state",
    """select f.id, right(f.departure, 4) as extracted_icao, a.state, a.municipality
from fx_flight_summaries f left join airports a on right(f.departure, 4) = a.icao_code""",
)
def join_airport_state(t):
    return R.join_airport_state(t.flight_summaries, _airports(t)).select("id", "extracted_icao", "state", "municipality")


@query(
    "pilot_origins",
    f"""select callsign, cid, departure as origin_airport, extracted_icao, state, municipality, completion_time,
 cast(controller_time_percentage as double) as controller_time_percentage
from (select f.*, right(f.departure, 4) as extracted_icao, a.state, a.municipality from fx_flight_summaries f
 left join airports a on right(f.departure, 4) = a.icao_code
 where f.departure like 'Y%' and length(f.departure) >= 4 and completion_time >= cast({O_NOW} as date) - interval {WIDE_DAYS} day
 order by completion_time desc nulls first, callsign, id, state, municipality limit 200) where state is not null""",
)
def pilot_origins(t):
    out = R.pilot_origins(t.flight_summaries, _airports(t), ORDERS_NOW, days=WIDE_DAYS)
    return out.withColumn("controller_time_percentage", F.col("controller_time_percentage").cast("double"))


# --- flight summaries ---


@query(
    "list_flight_summaries",
    """select id, callsign, departure, arrival, aircraft_type, flight_rules, completion_time from fx_flight_summaries
where departure = 'YSSY' and aircraft_type ilike '%b7%' order by completion_time desc, id limit 50 offset 20""",
)
def list_flight_summaries(t):
    out = R.list_flight_summaries(t.flight_summaries, departure="yssy", aircraft_type="b7", limit=50, offset=20)
    return out.select("id", "callsign", "departure", "arrival", "aircraft_type", "flight_rules", "completion_time")


@query(
    "list_flight_summaries_total",
    """select count(*) as total, 50 as "limit", 20 as "offset", 70 < count(*) as has_more from fx_flight_summaries
where departure = 'YSSY' and aircraft_type ilike '%b7%'""",
)
def list_flight_summaries_total(t):
    return R.list_flight_summaries_total(t.flight_summaries, departure="yssy", aircraft_type="b7", limit=50, offset=20)


@query(
    "summary_status",
    f"""select count(*) as total_summaries, count(case when completion_time >= {O_NOW} - interval 24 hour then 1 end) as last_24h,
 count(case when completion_time >= {O_NOW} - interval 1 hour then 1 end) as last_1h, max(completion_time) as last_processed,
 coalesce(avg(time_online_minutes), 0) as avg_time_online_minutes,
 coalesce({avg2_sql('controller_time_percentage', 4)}, 0) as avg_atc_coverage_percentage from fx_flight_summaries""",
)
def summary_status(t):
    return R.summary_status(t.flight_summaries, ORDERS_NOW, "completion_time")


@query(
    "summary_recent",
    """select callsign, departure, arrival, completion_time, time_online_minutes from fx_flight_summaries
order by completion_time desc, id limit 5""",
)
def summary_recent(t):
    return R.summary_recent(t.flight_summaries)


@query(
    "summary_top_routes",
    f"""select departure, arrival, count(*) as flight_count, coalesce(avg(time_online_minutes), 0) as avg_time_online_minutes,
 coalesce({avg2_sql('controller_time_percentage', 4)}, 0) as avg_atc_coverage_percentage
from fx_flight_summaries group by 1, 2 order by 3 desc, 1, 2 limit 10""",
)
def summary_top_routes(t):
    return R.summary_top_routes(t.flight_summaries, ORDERS_NOW, "all")


@query(
    "summary_top_aircraft",
    f"""select aircraft_type, count(*) as flight_count, coalesce(avg(time_online_minutes), 0) as avg_time_online_minutes
from fx_flight_summaries where completion_time >= {O_NOW} - interval 30 day and departure = 'YSSY'
group by 1 order by 2 desc, 1 limit 10""",
)
def summary_top_aircraft(t):
    return R.summary_top_aircraft(t.flight_summaries, ORDERS_NOW, "30d", departure="yssy")


@query(
    "summary_coverage_bands",
    f"""select case when controller_time_percentage = 0 then 'No ATC Contact'
 when controller_time_percentage <= 25 then 'Low ATC Contact (1-25%)' when controller_time_percentage <= 50 then 'Medium ATC Contact (26-50%)'
 when controller_time_percentage <= 75 then 'High ATC Contact (51-75%)' else 'Full ATC Contact (76-100%)' end as coverage_level,
 count(*) as flight_count from fx_flight_summaries where completion_time >= {O_NOW} - interval 7 day group by 1""",
)
def summary_coverage_bands(t):
    return R.summary_coverage_bands(t.flight_summaries, ORDERS_NOW, "7d")


_ARCHIVE_COLUMNS = ["deptime", "time_online_minutes", "total_enroute_time_minutes", "completion_time"]


def _rate(c: str) -> str:
    return percent_sql(f"count({c})", "count(*)")


@query(
    "archive_completeness",
    f"""select *, {ratio_sql(' + '.join(f'cast(round({c} * 100) as bigint)' for c in _ARCHIVE_COLUMNS), '400', 2)} as overall_completion_percentage
from (select count(*) as total_records, {', '.join(f'{_rate(c)} as {c}' for c in _ARCHIVE_COLUMNS)} from fx_flights_archive)""",
)
def archive_completeness(t):
    return R.archive_completeness(t.flights_archive, _ARCHIVE_COLUMNS)


_CID_WHERE = f"completion_time >= {O_NOW} - interval {WIDE_DAYS} day and cid is not null and cid // 100000 > 0"


@query(
    "flights_by_cid_prefix",
    f"""select cast(cid // 100000 as bigint) as cid_group, count(*) as total_flights, count(distinct cid) as unique_pilots
from fx_flight_summaries where {_CID_WHERE} group by 1""",
)
def flights_by_cid_prefix(t):
    return R.flights_by_cid_prefix(t.flight_summaries, ORDERS_NOW, days=WIDE_DAYS)


@query(
    "flights_by_cid_prefix_averages",
    f"""select cast(cid // 100000 as bigint) as cid_group, count(*) as total_flights, count(distinct cid) as unique_pilots,
 {avg_sql('time_online_minutes')} as avg_flight_duration_minutes, {avg2_sql('controller_time_percentage')} as avg_atc_contact_percentage
from fx_flight_summaries where {_CID_WHERE} group by 1""",
)
def flights_by_cid_prefix_averages(t):
    return R.flights_by_cid_prefix(t.flight_summaries, ORDERS_NOW, days=WIDE_DAYS, averages=True)


_VFR = "flight_rules = 'V' and departure <> '' and arrival <> '' and departure <> arrival"
_VFR_MEANS = f"{avg_sql('time_online_minutes')} as avg_flight_duration_minutes, {avg2_sql('controller_time_percentage')} as avg_atc_contact_percentage"
_VFR_DATES = ", min(completion_time) as first_flight_date, max(completion_time) as last_flight_date"


def _vfr(pilots: str, flights: str, dates: str, where: str, having: str, order: str, n: int, keys: str = "departure, arrival, ") -> str:
    return f"""select {keys}concat(departure, ' → ', arrival) as route, count(distinct callsign) as {pilots}, count(*) as {flights},
 {_VFR_MEANS}{dates} from fx_flight_summaries where {_VFR}{where} group by departure, arrival having {having} order by {order} limit {n}"""


@query("vfr_routes_by_pilots", _vfr("unique_pilots", "total_vfr_flights", _VFR_DATES, "", "count(distinct callsign) >= 3",
                                    "unique_pilots desc, total_vfr_flights desc, route", 25))
def vfr_routes_by_pilots(t):
    return R.vfr_routes_by_pilots(t.flight_summaries)


@query("vfr_routes_by_flights", _vfr("unique_pilots", "total_vfr_flights", _VFR_DATES, "", "count(*) >= 5",
                                     "total_vfr_flights desc, unique_pilots desc, route", 20))
def vfr_routes_by_flights(t):
    return R.vfr_routes_by_flights(t.flight_summaries)


@query("vfr_routes_last_30_days", _vfr("unique_pilots_last_30_days", "vfr_flights_last_30_days", "",
                                       f" and completion_time >= {O_NOW} - interval 30 day", "count(distinct callsign) >= 2",
                                       "unique_pilots_last_30_days desc, vfr_flights_last_30_days desc, route", 20))
def vfr_routes_last_30_days(t):
    return R.vfr_routes_last_30_days(t.flight_summaries, ORDERS_NOW)


@query(
    "vfr_routes_by_aircraft",
    f"""select aircraft_type, count(distinct callsign) as unique_pilots, count(*) as total_vfr_flights,
 count(distinct concat(departure, ' → ', arrival)) as unique_routes_flown, {_VFR_MEANS}
from fx_flight_summaries where flight_rules = 'V' and aircraft_type <> '' group by 1
having count(distinct callsign) >= 5 order by 2 desc, 3 desc, 1 limit 15""",
)
def vfr_routes_by_aircraft(t):
    return R.vfr_routes_by_aircraft(t.flight_summaries, "aircraft_type")


@query("vfr_routes_simple", _vfr("unique_pilots", "total_vfr_flights", _VFR_DATES, f" and completion_time >= {O_NOW} - interval 30 day",
                                 "count(distinct callsign) >= 3", "unique_pilots desc, total_vfr_flights desc, route", 10, keys=""))
def vfr_routes_simple(t):
    return R.vfr_routes_simple(t.flight_summaries, ORDERS_NOW)


# Types of this run; the full list is a parameter of the report.
MILITARY = ["F14", "F15", "F16", "F18", "F18S", "F22", "F35", "C130", "C17", "P3", "P8", "F-%", "MIG%"]
_MILITARY = ", ".join(f"'{x}'" for x in MILITARY)


@query(
    "military_routes",
    f"""select departure, arrival, aircraft_type, total_flights, unique_pilots,
 {percent_sql('total_flights', 'sum(total_flights) over ()')} as percentage_of_total_military_flights,
 {percent_sql('unique_pilots', 'sum(unique_pilots) over ()')} as percentage_of_total_military_pilots
from (select departure, arrival, aircraft_type, count(*) as total_flights, count(distinct cid) as unique_pilots
 from fx_flight_summaries where aircraft_type in ({_MILITARY}) and completion_time >= {O_NOW} - interval {WIDE_WEEKS * 7} day
 and departure <> '' and arrival <> '' group by 1, 2, 3)""",
)
def military_routes(t):
    return R.military_routes(t.flight_summaries, ORDERS_NOW, MILITARY, weeks=WIDE_WEEKS)


def _category_case(col: str) -> str:
    parts = []
    for rule in CATEGORY_RULES:
        hits = [f"{col} like '%{w}%'" for w in rule.contains.split()] + [f"{col} = '{w}'" for w in rule.equals.split()]
        needs = [f"{col} not like '%{w}%'" for w in rule.excludes.split()]
        needs += [f"regexp_matches({col}, '{rule.pattern}')"] if rule.pattern else []
        parts.append(f"when {' and '.join(['(' + ' or '.join(hits) + ')'] + needs)} then '{rule.category}'")
    return f"case {' '.join(parts)} else '{OTHER_CATEGORY}' end"


# Aircraft types: those of the summaries and of the stored flights together.
shared_cte(
    "typed_rows",
    "select aircraft_type from fx_flights union all select aircraft_type from fx_flight_summaries",
)


@query(
    "aircraft_categories",
    f"""select aircraft_type, count(*) as flights, {_category_case('aircraft_type')} as aircraft_category
from typed_rows where aircraft_type <> '' group by 1""",
)
def aircraft_categories(t):
    rows = t.flights.select("aircraft_type").unionByName(t.flight_summaries.select("aircraft_type"))
    return R.aircraft_categories(rows)


shared_cte(
    "categorised",
    f"""select *, {_category_case('aircraft_type')} as category from fx_flight_summaries
where aircraft_type <> '' and total_enroute_time_minutes > 0 and completion_time >= {O_NOW} - interval {WIDE_MONTHS} month""",
)


@query(
    "popular_categories",
    f"""select category as type, count(*) as total_flights, count(distinct cid) as unique_pilots,
 concat(cast(cast({avg2_sql('controller_time_percentage')} as decimal(10,1)) as varchar), '%') as avg_time_with_atc
from categorised group by 1""",
)
def popular_categories(t):
    return R.popular_categories(t.flight_summaries, ORDERS_NOW, months=WIDE_MONTHS)


@query(
    "category_stats",
    f"""select category as aircraft_category, count(*) as total_flights, count(distinct aircraft_type) as unique_aircraft_types,
 {avg_sql('total_enroute_time_minutes')} as avg_flight_duration_minutes, {avg_sql('time_online_minutes')} as avg_time_online_minutes,
 {percent_sql("count(case when controller_callsigns is not null and controller_callsigns <> '{}' then 1 end)", 'count(*)', 1)} as percent_with_controllers,
 round(avg(total_enroute_time_minutes / nullif(time_online_minutes, 0)), 2) as avg_efficiency_ratio
from categorised group by 1""",
)
def category_stats(t):
    return R.category_stats(t.flight_summaries, ORDERS_NOW, months=WIDE_MONTHS)


# --- city pair ---

_SPEED = "cast(440 // nullif({m} // 60, 0) as double)"
_TOWERS = "controller_callsigns like '%SY_TWR%' and controller_callsigns like '%ML_TWR%'"


@query(
    "fastest_city_pair",
    f"""select row_number() over (order by time_online_minutes, id) as rank, callsign, name as pilot_name, aircraft_type, departure, arrival,
 logon_time as departure_time, completion_time as arrival_time, time_online_minutes as flight_duration_minutes,
 len(json_keys(controller_callsigns)) as total_controllers, {_SPEED.format(m='time_online_minutes')} as avg_speed_knots
from fx_flight_summaries where departure = 'YSSY' and arrival = 'YMML' and completion_time >= {O_NOW} - interval {WIDE_MONTHS} month
 and time_online_minutes > 0 and {_TOWERS} order by time_online_minutes, id limit 20""",
)
def fastest_city_pair(t):
    return R.fastest_city_pair(t.flight_summaries, ORDERS_NOW, months=WIDE_MONTHS)


_DAY = "2001-08-01 00:00:00"


@query(
    "fastest_city_pair_day",
    f"""select callsign, aircraft_type, name as pilot_name, departure, arrival, logon_time as departure_time, completion_time as arrival_time,
 time_online_minutes as flight_duration_minutes, flight_rules,
 case when controller_callsigns is not null then len(json_keys(controller_callsigns)) else 0 end as total_controllers,
 case when time_online_minutes > 0 then {_SPEED.format(m='time_online_minutes')} end as avg_speed_knots,
 case when {_TOWERS} then 'Both Towers' when controller_callsigns like '%SY_TWR%' then 'Sydney Only'
  when controller_callsigns like '%ML_TWR%' then 'Melbourne Only' else 'No Tower Contact' end as tower_contact_status, controller_callsigns
from fx_flight_summaries where (departure = 'YSSY' and arrival = 'YMML') or (departure = 'YMML' and arrival = 'YSSY')
 and completion_time >= {O_NOW} - interval 1 day and completion_time < {O_NOW} and time_online_minutes > 0
 and {_TOWERS} and len(json_keys(controller_callsigns)) >= 5""",
)
def fastest_city_pair_day(t):
    return R.fastest_city_pair_day(t.flight_summaries, _DAY)


@query(
    "city_pair_stats",
    f"""select count(*) as total_flights_both_towers, count(case when departure = 'YSSY' then 1 end) as sydney_to_melbourne_both_towers,
 count(case when departure = 'YMML' then 1 end) as melbourne_to_sydney_both_towers, {avg_sql('time_online_minutes')} as avg_flight_duration_minutes,
 cast(min(time_online_minutes) as double) as fastest_flight_minutes, cast(max(time_online_minutes) as double) as slowest_flight_minutes,
 {avg_sql('440 // nullif(time_online_minutes // 60, 0)')} as avg_speed_knots
from fx_flight_summaries where ((departure = 'YSSY' and arrival = 'YMML') or (departure = 'YMML' and arrival = 'YSSY'))
 and completion_time >= {O_NOW} - interval {WIDE_DAYS} day and completion_time < {O_NOW} and time_online_minutes > 0
 and {_TOWERS} and len(json_keys(controller_callsigns)) >= 5""",
)
def city_pair_stats(t):
    return R.city_pair_stats(t.flight_summaries, _DAY, days=WIDE_DAYS)


_MONDAY = f"""departure = 'YMML' and arrival = 'YSSY' and completion_time >= {O_NOW} - interval {WIDE_MONTHS} month and dayofweek(completion_time) = 1
 and total_enroute_time_minutes > 0 and controller_callsigns is not null
 and list_contains(json_keys(controller_callsigns), 'SY_TWR') and list_contains(json_keys(controller_callsigns), 'ML_TWR')
 and len(list_filter(json_keys(controller_callsigns), lambda k: k like '%GND%')) >= 2"""


@query(
    "fastest_city_pair_monday",
    f"""select row_number() over (order by total_enroute_time_minutes, id) as rank, callsign, name as pilot_name, aircraft_type, departure, arrival,
 logon_time as departure_time, completion_time as arrival_time, total_enroute_time_minutes as flight_duration_minutes,
 'Monday' as completion_day_name, true as contacted_sydney_tower, true as contacted_melbourne_tower,
 len(list_filter(json_keys(controller_callsigns), lambda k: k like '%GND%')) as ground_controllers_contacted,
 len(json_keys(controller_callsigns)) as total_controllers, {_SPEED.format(m='total_enroute_time_minutes')} as avg_speed_knots
from fx_flight_summaries where {_MONDAY} order by total_enroute_time_minutes, id limit 20""",
)
def fastest_city_pair_monday(t):
    return R.fastest_city_pair_monday(t.flight_summaries, ORDERS_NOW, months=WIDE_MONTHS)


@query(
    "city_pair_monday_stats",
    f"""select count(*) as total_monday_flights, {avg_sql('total_enroute_time_minutes')} as avg_flight_time_minutes,
 min(total_enroute_time_minutes) as fastest_flight_minutes, max(total_enroute_time_minutes) as slowest_flight_minutes,
 round(stddev_samp(total_enroute_time_minutes), 1) as std_dev_minutes,
 {avg_sql('len(json_keys(controller_callsigns))')} as avg_controllers_contacted, count(distinct aircraft_type) as unique_aircraft_types
from fx_flight_summaries where {_MONDAY}""",
)
def city_pair_monday_stats(t):
    return R.city_pair_monday_stats(t.flight_summaries, ORDERS_NOW, months=WIDE_MONTHS)
