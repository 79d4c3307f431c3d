"""Queries of the filters and of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtrace.functions import callsign as N
from airtrace.functions.geo import deg_within, nm_within, parse_coordinate, point_in_polygon
from airtrace.functions.values import at, parse_utc
from airtrace.operators import filters as X
from airtrace.registry.base import query, shared_cte
from airtrace.registry.derived import AS_OF_EVENTS as NOW
from airtrace.registry.match_queries import LIMIT_CASE, NM, TYPE_CASE
from airtrace.registry.contact_queries import POSITION_CASE

E_NOW = f"timestamp '{NOW}'"

# A convex boundary (lat, lon) whose edges pass between the grid of positions.
RING = [(-39.53, 117.07), (-37.11, 149.03), (-22.37, 153.53), (-16.03, 138.11), (-18.57, 118.23)]
EXCLUDED_MHZ = ["118.000", "118.505", "118.700"]
PATTERNS = ["STN3", "LT1"]


def _inside(lat: str, lon: str) -> str:
    """Left of no edge: strict containment in the convex ring."""
    points = [*RING, RING[0]]
    sides = [
        f"(({c} - {a})) * (({lon}) - {b}) - (({d} - {b})) * (({lat}) - {a}) < 0"
        for (a, b), (c, d) in zip(points, points[1:])
    ]
    flipped = [x.replace("< 0", "> 0") for x in sides]
    return f"(({' and '.join(sides)}) or ({' and '.join(flipped)}))"


_IN_FLIGHT = _inside("latitude", "longitude")
_IN_RADIO = _inside("position_lat", "position_lon")


@query("point_in_polygon", f"select id, coalesce({_IN_FLIGHT}, false) as inside from fx_flights")
def point_in_polygon_query(t):
    return t.flights.select("id", point_in_polygon(F.col("latitude"), F.col("longitude"), RING).alias("inside"))


@query("filter_boundary_flights", f"select id, callsign, latitude, longitude from fx_flights where latitude is null or longitude is null or {_IN_FLIGHT}")
def filter_boundary_flights(t):
    return X.filter_boundary_flights(t.flights, RING).select("id", "callsign", "latitude", "longitude")


@query("filter_boundary_transceivers", f"select id, callsign from fx_transceivers where position_lat is null or position_lon is null or {_IN_RADIO}")
def filter_boundary_transceivers(t):
    return X.filter_boundary_transceivers(t.transceivers, RING).select("id", "callsign")


@query(
    "filter_boundary_snapshot",
    f"""select last_updated as poll, count(*) as pilots from fx_flights where latitude is null or longitude is null or {_IN_FLIGHT} group by 1""",
)
def filter_boundary_snapshot(t):
    polls = t.flights.groupBy(F.col("last_updated").alias("poll")).agg(
        F.collect_list(F.struct("callsign", "latitude", "longitude")).alias("pilots")
    )
    kept = X.filter_boundary_snapshot(polls, RING)
    return kept.select("poll", F.size("pilots").cast("long").alias("pilots")).where("pilots > 0")


# The allow-list is derived from the suppliers: stations of three in four residues.
shared_cte(
    "allowed",
    """select distinct concat('STN', s_suppkey % 6, case when s_suppkey % 6 < 2 then '_GND' when s_suppkey % 6 < 4 then '_TWR' else '_APP' end) as callsign
from supplier""",
)


def allowed(t):
    k = F.col("s_suppkey") % 6
    suffix = F.when(k < 2, "_GND").when(k < 4, "_TWR").otherwise("_APP")
    return t.table("supplier").select(F.concat(F.lit("STN"), k.cast("string"), suffix).alias("callsign")).distinct()


@query("filter_controller_allowlist", "select id, callsign from fx_controllers where callsign in (select callsign from allowed)")
def filter_controller_allowlist(t):
    return X.filter_controller_allowlist(t.controllers, allowed(t)).select("id", "callsign")


@query(
    "cleanup_invalid_controllers",
    """select 'keep' as action, count(*) as n_rows, count(distinct callsign) as n_callsigns from fx_controllers where callsign in (select callsign from allowed)
union all select 'remove', count(*), count(distinct callsign) from fx_controllers where callsign not in (select callsign from allowed)""",
)
def cleanup_invalid_controllers(t):
    return X.cleanup_report(t.controllers, allowed(t))


@query("filter_callsign_pattern", "select id, callsign from fx_transceivers where callsign not like '%STN3%' and callsign not like '%LT1%'")
def filter_callsign_pattern(t):
    return X.filter_callsign_pattern(t.transceivers, PATTERNS).select("id", "callsign")


# odd offsets bring in frequencies between two kHz
_HZ = "(frequency + (id % 1000) * 7)"
_KHZ = f"({_HZ} // 1000 + case when {_HZ} % 1000 > 500 or ({_HZ} % 1000 = 500 and ({_HZ} // 1000) % 2 = 1) then 1 else 0 end)"
_KEPT = f"{_KHZ} not in (118000, 118505, 118700)"


def _offset(t):
    return t.transceivers.withColumn("frequency", F.col("frequency") + (F.col("id") % 1000) * 7)


@query("filter_frequency", f"select id, {_HZ} as frequency from fx_transceivers where {_KEPT}")
def filter_frequency(t):
    return X.filter_frequency(_offset(t), EXCLUDED_MHZ).select("id", "frequency")


@query(
    "filter_daily_stats",
    f"""select cast(ts as date) as day, count(*) as processed, count(case when {_KEPT} then 1 end) as included,
 count(case when not ({_KEPT}) then 1 end) as excluded from fx_transceivers where cast(ts as date) >= cast({E_NOW} as date) - interval 7 day group by 1""",
)
def filter_daily_stats(t):
    kept = X.frequency_kept(F.col("frequency"), EXCLUDED_MHZ)
    return X.filter_daily_stats(_offset(t), kept, "timestamp", at(NOW))


@query(
    "filter_counts",
    f"""select count(*) as processed, count(case when latitude is null or longitude is null or {_IN_FLIGHT} then 1 end) as included,
 count(case when not (latitude is null or longitude is null or {_IN_FLIGHT}) then 1 end) as excluded,
 count(case when latitude is null or longitude is null then 1 end) as no_position from fx_flights""",
)
def filter_counts(t):
    lat, lon = F.col("latitude"), F.col("longitude")
    unknown = lat.isNull() | lon.isNull()
    return X.filter_counts(t.flights, unknown | point_in_polygon(lat, lon, RING), unknown)


@query("filter_incomplete_plan", "select id, departure, arrival from fx_flights where departure <> '' and arrival <> ''")
def filter_incomplete_plan(t):
    return X.filter_incomplete_plan(t.flights).select("id", "departure", "arrival")


_ISO = "concat(strftime(last_updated, '%Y-%m-%dT%H:%M:%S'), '.', lpad(cast(id % 1000 as varchar), 3, '0'), 'Z')"


@query("normalize_timestamps", "select id, case when id % 13 = 0 then null else last_updated end as last_updated from fx_flights")
def normalize_timestamps(t):
    fraction = F.lpad((F.col("id") % 1000).cast("string"), 3, "0")
    iso = F.concat(F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), fraction, F.lit("Z"))
    text = F.when(F.col("id") % 13 == 0, F.concat(F.lit("bad "), iso)).otherwise(iso)
    return t.flights.select("id", parse_utc(text).alias("last_updated"))


@query(
    "atis_to_text",
    "select id, case when id % 5 = 0 then null else concat('Information ', callsign, ' QNH ', cast(rating as varchar)) end as text_atis from fx_controllers",
)
def atis_to_text(t):
    lines = F.when(
        F.col("id") % 5 != 0,
        F.array(F.lit("Information"), F.col("callsign"), F.concat(F.lit("QNH "), F.col("rating").cast("string"))),
    )
    return t.controllers.select("id", X.join_atis(lines).alias("text_atis"))


# DDMMSS text made from the altitude and heading of each row
_D, _M, _S = "altitude % 90", "heading % 60", "altitude % 60"


@query(
    "normalize_coordinates",
    f"""select id, case when id % 11 = 0 then null when id % 3 = 0 then round(cast(-(altitude % 90) - 0.25 as double), 6)
 else round(-({_D} + ({_M}) / 60e0 + ({_S}) / 3600e0), 6) end as degrees from fx_flights""",
)
def normalize_coordinates(t):
    def two(value):
        return F.lpad(value.cast("string"), 2, "0")

    d, m, s = F.col("altitude") % 90, F.col("heading") % 60, F.col("altitude") % 60
    dms = F.concat(F.lit("-"), two(d), two(m), two(s), F.lit(".000"))
    decimal = F.concat(F.lit("-"), d.cast("string"), F.lit(".25"))
    text = F.when(F.col("id") % 11 == 0, "no coordinate").when(F.col("id") % 3 == 0, decimal).otherwise(dms)
    return t.flights.select("id", F.round(parse_coordinate(text), 6).alias("degrees"))


_KIND = (
    "case upper(right(callsign, 3)) when 'GND' then 'Ground' when 'DEL' then 'Ground' when 'TWR' then 'Tower' when 'APP' then 'Approach' "
    "when 'DEP' then 'Approach' when 'CTR' then 'Center' when 'FSS' then 'FSS' else 'Ground' end"
)


@query("controller_type", f"select id, callsign, {_KIND} as type from fx_transceivers")
def controller_type(t):
    return t.transceivers.select("id", "callsign", N.controller_type(F.col("callsign")).alias("type"))


@query("proximity_nm", f"select id, {LIMIT_CASE.format(c='callsign')} as limit_nm from fx_transceivers")
def proximity_nm(t):
    return t.transceivers.select("id", N.proximity_nm(N.controller_type(F.col("callsign"))).alias("limit_nm"))


@query(
    "controller_info",
    f"""select distinct callsign, {_KIND} as type, {LIMIT_CASE.format(c='callsign')} as proximity_range,
 {LIMIT_CASE.format(c='callsign')} as proximity_threshold, 'last_three_chars' as detection_method from fx_controllers""",
)
def controller_info(t):
    return N.controller_info(t.controllers)


@query("contact_type", f"select id, {TYPE_CASE.format(c='upper(callsign)')} as type from fx_transceivers")
def contact_type(t):
    return t.transceivers.select("id", N.contact_type(F.col("callsign")).alias("type"))


_SESSION = (
    "case when callsign like '%GND%' then 'GND' when callsign like '%TWR%' then 'TWR' when callsign like '%APP%' then 'APP' "
    "when callsign like '%CTR%' then 'CTR' when callsign like '%FSS%' then 'FSS' when callsign like '%DEL%' then 'DEL' else 'OTHER' end"
)


@query("position_type", f"select id, {POSITION_CASE.format(c='callsign')} as position, {_SESSION} as session_position from fx_transceivers")
def position_type(t):
    c = F.col("callsign")
    return t.transceivers.select(
        "id", N.position_type(c).alias("position"), N.position_type(c, N.SESSION_ORDER).alias("session_position")
    )


# distance of each position to the middle of the area
@query(
    "nm_within",
    f"""select id, coalesce({NM.format(a='latitude', b='longitude', c='(-30.03)', d='(135.07)')} <= 400, false) as near from fx_flights""",
)
def nm_within_query(t):
    near = nm_within(F.col("latitude"), F.col("longitude"), F.lit(-30.03), F.lit(135.07), 400)
    return t.flights.select("id", near.alias("near"))


@query("deg_within", "select id, sqrt(pow(latitude + 30.03, 2) + pow(longitude - 135.07, 2)) <= 9.5 as near from fx_flights")
def deg_within_query(t):
    near = deg_within(F.col("latitude"), F.col("longitude"), F.lit(-30.03), F.lit(135.07), 9.5)
    return t.flights.select("id", near.alias("near"))


@query("mask_names", f"select id, callsign, 'x' as name, {E_NOW} as updated_at from fx_controllers")
def mask_names(t):
    return X.mask_names(t.controllers, at(NOW)).select("id", "callsign", "name", "updated_at")
