"""Queries of the sources and sinks.

The documents and files they read are written by Spark from the derived tables
into the shared folder, so their size follows the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airtrace import schemas
from airtrace.functions.callsign import RANK_NAMES
from airtrace.functions.values import at
from airtrace.operators import filters as X
from airtrace.operators.sectors import main_sector_for_point, sector_for_point
from airtrace.plans import contact_reports
from airtrace.plans.flight_reports import join_airport_state
from airtrace.registry.base import percent_sql, query, shared_cte
from airtrace.registry.flight_queries import _airports
from airtrace.session import shared_folder
from airtrace.sources import adhoc, reference, snapshots
from airtrace.sources.reference import rectangle_sectors


def _iso(col: str):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def poll_documents(t) -> DataFrame:
    """One document per minute with both feeds, as they land."""
    plan = F.when(
        F.col("departure") != "",
        F.struct(
            "flight_rules", F.col("aircraft_type").alias("aircraft_short"), "departure", "arrival",
            F.lit("FL350").alias("altitude"), "deptime",
        ),
    )
    pilot = F.struct(
        "cid", "name", "callsign", "latitude", "longitude", "altitude", "groundspeed", "heading",
        plan.alias("flight_plan"), _iso("logon_time").alias("logon_time"), _iso("last_updated").alias("last_updated"),
    )
    pilots = t.flights.groupBy(F.col("last_updated").alias("poll")).agg(F.collect_list(pilot).alias("pilots"))
    controller = F.struct(
        "cid", "name", "callsign", "frequency", "facility", "rating",
        _iso("last_updated").alias("last_updated"), _iso("logon_time").alias("logon_time"),
    )
    controllers = t.controllers.groupBy(F.col("last_updated").alias("poll")).agg(
        F.collect_list(controller).alias("controllers")
    )
    radio = F.struct(
        F.lit(0).alias("id"), "frequency", F.col("position_lat").alias("latDeg"), F.col("position_lon").alias("lonDeg")
    )
    radios = t.transceivers.groupBy(F.col("timestamp").alias("poll"), "callsign").agg(F.collect_list(radio).alias("transceivers"))
    radios = radios.groupBy("poll").agg(F.collect_list(F.struct("callsign", "transceivers")).alias("transceivers"))
    return (
        pilots.join(controllers, "poll", "left").join(radios, "poll", "left")
        .withColumn("poll_time", _iso("poll")).drop("poll")
    )


def landed_polls(t) -> str:
    path = shared_folder(t.spark, "polls")
    poll_documents(t).write.json(path)
    return path


def read_polls(t) -> DataFrame:
    return snapshots.src_snapshots(t.spark, landed_polls(t), schemas.POLL)


@query(
    "src_snapshots",
    """select f.poll as poll_time, f.n as pilots, coalesce(c.n, 0) as controllers from (select last_updated as poll, count(*) as n from fx_flights group by 1) f
left join (select last_updated as poll, count(*) as n from fx_controllers group by 1) c on f.poll = c.poll""",
)
def src_snapshots(t):
    from airtrace.functions.values import parse_utc

    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return read_polls(t).select(
        parse_utc(F.col("poll_time")).alias("poll_time"), size("pilots").alias("pilots"),
        F.when(F.col("controllers").isNull(), 0).otherwise(size("controllers")).alias("controllers"),
    )


_PARSED = """select callsign, case when departure = '' then '' else aircraft_type end as aircraft_type, latitude, longitude, altitude, heading, groundspeed,
 departure, case when departure = '' then '' else arrival end as arrival, '' as route, case when departure = '' then null else flight_rules end as flight_rules,
 case when departure = '' then null else 'FL350' end as planned_altitude, case when departure = '' then null else deptime end as deptime,
 cid, name, logon_time, last_updated from fx_flights"""
shared_cte("parsed_flights", _PARSED)


@query("parse_flights", "select * from parsed_flights")
def parse_flights(t):
    return snapshots.parse_flights(read_polls(t)).select(
        "callsign", "aircraft_type", "latitude", "longitude", "altitude", "heading", "groundspeed", "departure", "arrival",
        "route", "flight_rules", "planned_altitude", "deptime", "cid", "name", "logon_time", "last_updated",
    )


@query("parse_controllers", "select callsign, frequency, cid, name, rating, facility, '' as server, cast(null as varchar) as text_atis, last_updated, logon_time from fx_controllers")
def parse_controllers(t):
    return snapshots.parse_controllers(read_polls(t)).drop("visual_range")


@query("parse_transceivers", "select callsign, 0 as transceiver_id, frequency, position_lat, position_lon, 'flight' as entity_type from fx_transceivers")
def parse_transceivers(t):
    return snapshots.parse_transceivers(read_polls(t)).drop("height_msl", "height_agl", "timestamp")


_LINKED = """select t.callsign, t.frequency, case when f.callsign is not null then 'flight' when c.callsign is not null then 'atc' else 'flight' end as entity_type
from fx_transceivers t left join (select distinct callsign from fx_flights) f on t.callsign = f.callsign
left join (select distinct callsign from fx_controllers) c on t.callsign = c.callsign"""


@query("link_transceivers", _LINKED)
def link_transceivers(t):
    return snapshots.link_transceivers(
        t.transceivers.select("callsign", "frequency"), t.flights, t.controllers
    ).select("callsign", "frequency", "entity_type")


# --- files of reference data ---

# The boundary follows the data: a diamond around the middle of all positions.
shared_cte(
    "diamond",
    "select (min(latitude) + max(latitude)) / 2 + 0.013e0 as a, (min(longitude) + max(longitude)) / 2 + 0.017e0 as b from fx_flights",
)
_DIAMOND = "abs(f.latitude - d.a) / 9e0 + abs(f.longitude - d.b) / 14e0 < 1e0"


def _diamond_edges(t) -> DataFrame:
    a = ((F.min("latitude") + F.max("latitude")) / 2 + 0.013).alias("a")
    b = ((F.min("longitude") + F.max("longitude")) / 2 + 0.017).alias("b")
    lonlat = "array(array(b, a - 9), array(b + 14, a), array(b, a + 9), array(b - 14, a), array(b, a - 9))"
    doc = t.flights.agg(a, b).select(
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.expr(f"array({lonlat})").alias("coordinates"))).alias("value")
    )
    path = shared_folder(t.spark, "boundary")
    doc.write.text(path)
    return reference.src_polygon(t.spark, path)


@query("src_polygon", f"select f.id, f.callsign from fx_flights f, diamond d where f.latitude is null or f.longitude is null or {_DIAMOND}")
def src_polygon(t):
    return X.filter_boundary_flights(t.flights, _diamond_edges(t)).select("id", "callsign")


# One rectangle per nation in a grid of five by five.
shared_cte(
    "nation_sectors",
    """select n_nationkey as ord, n_name as sector_name, n_regionkey, -40e0 + (n_nationkey % 5) * 5e0 as lat_min, -35.01e0 + (n_nationkey % 5) * 5e0 as lat_max,
 115e0 + (n_nationkey // 5) * 8e0 as lon_min, 122.99e0 + (n_nationkey // 5) * 8e0 as lon_max from nation""",
)
_IN_NATION = "f.latitude > s.lat_min and f.latitude < s.lat_max and f.longitude > s.lon_min and f.longitude < s.lon_max"


def _nation_rectangles(t) -> DataFrame:
    k = F.col("n_nationkey")
    row, column = (k % 5) * 5.0, F.floor(k / 5) * 8.0
    return t.table("nation").select(
        k.cast("int").alias("ord"), F.col("n_name").alias("sector_name"), "n_regionkey",
        (row - 40.0).alias("lat_min"), (row - 35.01).alias("lat_max"),
        (column + 115.0).alias("lon_min"), (column + 122.99).alias("lon_max"),
    )


def _landed_sectors(t) -> DataFrame:
    ring = "array(array(lon_min, lat_min), array(lon_max, lat_min), array(lon_max, lat_max), array(lon_min, lat_max), array(lon_min, lat_min))"
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("sector_name").alias("name"), F.concat(F.lit("NAT"), F.col("ord").cast("string")).alias("callsign")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.expr(f"array({ring})").alias("coordinates")).alias("geometry"),
    )
    numbered = _nation_rectangles(t).select("ord", feature.alias("f"))
    doc = numbered.agg(F.sort_array(F.collect_list(F.struct("ord", "f"))).alias("l")).select(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("l", lambda x: x["f"]).alias("features"))).alias("value")
    )
    path = shared_folder(t.spark, "sectors")
    doc.write.text(path)
    return reference.src_sectors(t.spark, path)


@query(
    "src_sectors",
    f"""select s.sector_name, concat('NAT', s.ord) as callsign, 'N/A' as frequency, count(*) as positions from fx_flights f
join nation_sectors s on {_IN_NATION} group by 1, 2, 3""",
)
def src_sectors(t):
    sectors = _landed_sectors(t)
    placed = sector_for_point(t.flights, sectors).groupBy("sector_name").agg(F.count(F.lit(1)).alias("positions"))
    return placed.join(sectors, "sector_name").select("sector_name", "callsign", "frequency", "positions")


@query(
    "src_sector_hierarchy",
    f"""select r.r_name as main_sector, count(*) as positions from fx_flights f join nation_sectors s on {_IN_NATION}
join region r on r.r_regionkey = s.n_regionkey group by 1""",
)
def src_sector_hierarchy(t):
    named = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = named.groupBy("r_name").agg(F.concat_ws(",", F.sort_array(F.collect_list("n_name"))).alias("subs"))
    path = shared_folder(t.spark, "hierarchy")
    lines.select(F.concat("r_name", F.lit(":"), "subs").alias("value")).write.text(path)
    hierarchy = reference.src_sector_hierarchy(t.spark, path)
    placed = main_sector_for_point(t.flights, rectangle_sectors(_nation_rectangles(t)), hierarchy)
    return placed.where("main_sector is not null").groupBy("main_sector").agg(F.count(F.lit(1)).alias("positions"))


@query(
    "src_valid_callsigns",
    "select id, callsign from fx_controllers where callsign in (select callsign from fx_transceivers where entity_type = 'atc' and frequency < 118400000)",
)
def src_valid_callsigns(t):
    listed = t.transceivers.where("entity_type = 'atc' and frequency < 118400000").select("callsign").distinct()
    # blank and comment lines are part of such files
    lines = listed.select(F.explode(F.array(F.lit("# station"), F.lit(""), F.concat(F.lit("  "), "callsign"))).alias("value"))
    path = shared_folder(t.spark, "callsigns")
    lines.write.text(path)
    allow = reference.src_valid_callsigns(t.spark, path)
    return X.filter_controller_allowlist(t.controllers, allow).select("id", "callsign")


@query(
    "src_airport_states",
    """select a.state, count(*) as flights from fx_flight_summaries f left join airports a on right(f.departure, 4) = a.icao_code group by 1""",
)
def src_airport_states(t):
    path = shared_folder(t.spark, "airports")
    _airports(t).write.option("header", True).csv(path)
    airports = reference.src_airport_states(t.spark, path)
    return join_airport_state(t.flight_summaries, airports).groupBy("state").agg(F.count(F.lit(1)).alias("flights"))


# --- sinks ---


@query("sink_append", "select cast(last_updated as date) as date, count(*) as n_rows, count(distinct callsign) as callsigns from fx_flights group by 1")
def sink_append(t):
    path = shared_folder(t.spark, "appended")
    rows = t.flights.select("id", "callsign", "latitude", "longitude", "last_updated")
    # two appends make the table whole
    early = F.col("last_updated") < at("2024-01-01 00:10:00")
    snapshots.sink_append(rows.where(early), path, "last_updated")
    snapshots.sink_append(rows.where(~early), path, "last_updated")
    return t.spark.read.parquet(path).groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("callsign").alias("callsigns")
    )


@query(
    "sink_csv_report",
    f"""select t.callsign, t.n as total_flight_data_records, coalesce(c.n, 0) as flight_data_records_in_contact_with_atc,
 {percent_sql('coalesce(c.n, 0)', 't.n')} as percentage_with_atc from (select callsign, count(*) as n from fx_flights group by 1) t
left join (select callsign, count(*) as n from contact_rows group by 1) c on t.callsign = c.callsign""",
)
def sink_csv_report(t):
    report = contact_reports.pct_time_by_aircraft(t.flights, t.transceivers, t.controllers)
    path = shared_folder(t.spark, "report")
    snapshots.sink_csv_report(report, path)
    return t.spark.read.schema(report.schema).option("header", True).csv(path)


# --- ad hoc ---


@query("adhoc_sql", "select departure, arrival, count(*) as flights, max(altitude) as highest from fx_flights group by 1, 2")
def adhoc_sql(t):
    sql = "select departure, arrival, count(*) as flights, max(altitude) as highest from {flights} group by departure, arrival"
    return adhoc.adhoc_sql(t.spark, sql, 1000, flights=t.flights)


_RANKS = " union all ".join(f"select {k} as rating, '{v}' as rank_name" for k, v in RANK_NAMES.items())


@query("union_literals", f"select r.rank_name, count(*) as controllers from fx_controllers c join ({_RANKS}) r on c.rating = r.rating group by 1")
def union_literals(t):
    ranks = reference.union_literals(t.spark, list(RANK_NAMES.items()), "rating int, rank_name string")
    return t.controllers.join(ranks, "rating").groupBy("rank_name").agg(F.count(F.lit(1)).alias("controllers"))
