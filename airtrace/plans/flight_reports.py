"""Reports over stored flight positions and over flight summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from airtrace.functions.aircraft import aircraft_category, speed_excluded
from airtrace.functions.exact import percent, rounded_avg, rounded_ratio, whole_minutes
from airtrace.functions.values import ago, at, nonblank, object_keys, object_text, upto


def _since(col: str, as_of, **parts) -> Column:
    return F.col(col) >= ago(as_of, **parts)


# --- stored positions ------------------------------------------------------


def flight_analytics_24h(flights: DataFrame, as_of) -> DataFrame:
    return flights.where(_since("last_updated", as_of, hours=24)).agg(
        F.countDistinct("callsign").alias("flights"),
        F.count(F.lit(1)).alias("positions"),
        F.coalesce(F.avg("groundspeed"), F.lit(0.0)).alias("avg_speed"),
        F.coalesce(F.max("altitude"), F.lit(0)).alias("max_alt"),
        F.countDistinct("departure").alias("departures"),
        F.countDistinct("arrival").alias("arrivals"),
    )


def flight_stats(flights: DataFrame, callsign: str | None = None) -> DataFrame:
    """Updates, mean speed, highest altitude and minutes per callsign."""
    rows = flights if callsign is None else flights.where(F.col("callsign") == callsign)
    return rows.groupBy("callsign").agg(
        F.count(F.lit(1)).alias("position_updates"),
        F.coalesce(F.avg("groundspeed"), F.lit(0.0)).alias("average_groundspeed"),
        F.coalesce(F.max("altitude"), F.lit(0)).alias("max_altitude"),
        whole_minutes(F.min("last_updated"), F.max("last_updated")).alias("flight_time_minutes"),
    )


def flight_track(flights: DataFrame, callsign: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Positions of one aircraft in time order (a range sort over its rows)."""
    rows = flights.where(F.col("callsign") == callsign)
    if start is not None:
        rows = rows.where(F.col("last_updated") >= start)
    if end is not None:
        rows = rows.where(F.col("last_updated") <= end)
    return rows.select(
        "callsign", "id", F.col("last_updated").alias("timestamp"), "latitude", "longitude", "altitude", "groundspeed"
    ).orderBy("timestamp", "id")


def flight_track_summary(flights: DataFrame, callsign: str) -> DataFrame:
    """Number of points and minutes of one track."""
    return flights.where(F.col("callsign") == callsign).groupBy("callsign").agg(
        F.count(F.lit(1)).alias("total_points"),
        whole_minutes(F.min("last_updated"), F.max("last_updated")).alias("flight_duration_minutes"),
    )


def latest_rows_by(rows: DataFrame, key: str, time: str, columns: Sequence[str], cutoff: Column | None = None) -> DataFrame:
    """Newest row per key. A partial maximum per task replaces a sort per key,
    so a key with very many rows costs no more than others."""
    if cutoff is not None:
        rows = rows.where(F.col(time) >= cutoff)
    rest = [c for c in columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(time, "id"))
    return rows.groupBy(key).agg(newest.alias("_n")).select(key, "_n.*")


FLIGHT_COLUMNS = [
    "callsign", "aircraft_type", "departure", "arrival", "latitude", "longitude", "altitude",
    "heading", "groundspeed", "cid", "name", "logon_time", "last_updated",
]
CONTROLLER_COLUMNS = ["callsign", "frequency", "cid", "name", "facility", "rating", "logon_time", "last_updated"]
RADIO_COLUMNS = ["callsign", "entity_type", "frequency", "position_lat", "position_lon", "timestamp"]


def latest_flights(flights: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    return latest_rows_by(upto(flights, "last_updated", as_of), "callsign", "last_updated", FLIGHT_COLUMNS, ago(as_of, mins=minutes))


def latest_flight(flights: DataFrame, callsign: str) -> DataFrame:
    return latest_rows_by(flights.where(F.col("callsign") == callsign), "callsign", "last_updated", FLIGHT_COLUMNS)


def latest_controllers(controllers: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    rows = upto(controllers, "last_updated", as_of)
    return latest_rows_by(rows, "callsign", "last_updated", CONTROLLER_COLUMNS, ago(as_of, mins=minutes))


def latest_transceivers(transceivers: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    rows = upto(transceivers, "timestamp", as_of)
    return latest_rows_by(rows, "callsign", "timestamp", RADIO_COLUMNS, ago(as_of, mins=minutes))


def latest_rows(table: DataFrame, time: str, n: int = 20) -> DataFrame:
    """The newest ``n`` rows with their clock time as text."""
    return (
        table.orderBy(F.col(time).desc_nulls_last(), F.col("id").desc())
        .limit(n)
        .withColumn("clock", F.date_format(time, "HH:mm:ss"))
    )


def top_groundspeed(flights: DataFrame, as_of, k: int = 20) -> DataFrame:
    """Fastest row per callsign, then the ``k`` fastest callsigns."""
    speed = F.col("groundspeed")
    rows = flights.where(
        (speed > 100) & (speed <= 750) & (F.col("altitude") > 1000)
        & _since("last_updated", as_of, months=1)
        & nonblank(F.col("arrival")) & ~speed_excluded(F.col("aircraft_type"))
    )
    columns = ["name", "aircraft_type", "departure", "arrival", "groundspeed", "altitude", "last_updated"]
    # highest speed first, the smaller id on a tie
    fastest = F.max_by(F.struct(*columns), F.struct("groundspeed", -F.col("id")))
    best = rows.groupBy("callsign").agg(fastest.alias("b")).select("callsign", "b.*")
    return best.orderBy(F.desc("groundspeed"), "callsign").limit(k).select(
        "callsign", F.col("name").alias("pilot_name"), "aircraft_type", "departure", "arrival",
        F.col("groundspeed").alias("peak_speed_knots"), F.col("altitude").alias("altitude_feet"),
        F.col("last_updated").alias("peak_time"),
    )


def flights_daily_activity(flights: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return flights.where(_since("last_updated", as_of, hours=hours)).agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.countDistinct("callsign").alias("unique_callsigns"),
        F.countDistinct(F.to_date("last_updated")).alias("active_days"),
    )


def sector_open_counts(stays: DataFrame) -> DataFrame:
    return stays.groupBy("sector_name").agg(
        F.count(F.lit(1)).alias("active_occupancies"),
        F.count_if(F.col("exit_timestamp").isNull()).alias("open_occupancies"),
    )


# --- pilot regions ----------------------------------------------------------

# Region by the fourth letter from the end of the pilot name.
REGIONS = {
    "Europe": ("L", "E"),
    "S & SE Asia": ("V", "W"),
    "East Asia": ("R",),
    "Australia": ("Y",),
    "United States": ("K",),
    "China": ("Z",),
    "NZ & Oceania": ("N",),
}


def pilot_regions(rows: DataFrame, time: str, as_of, n: int) -> DataFrame:
    """Distinct pilots per region of the last month, the ``n`` largest."""
    letter = F.substring("name", F.length("name") - 3, F.lit(1))
    region = None
    for name, letters in REGIONS.items():
        test = letter.isin(*letters)
        region = F.when(test, F.lit(name)) if region is None else region.when(test, F.lit(name))
    return (
        rows.where(_since(time, as_of, months=1) & (F.length("name") >= 4))
        .withColumn("region_name", region)
        .where(F.col("region_name").isNotNull())
        .groupBy("region_name")
        .agg(F.countDistinct("cid").alias("unique_pilots"))
        .orderBy(F.desc("unique_pilots"), "region_name")
        .limit(n)
    )


def join_airport_state(summaries: DataFrame, airports: DataFrame) -> DataFrame:
    """Add state and town by the last four letters of the departure.

    A code listed twice gives two rows.
    """
    code = F.right("departure", F.lit(4))
    return summaries.withColumn("extracted_icao", code).join(
        airports, F.col("extracted_icao") == F.col("icao_code"), "left"
    ).drop("icao_code")


def pilot_origins(summaries: DataFrame, airports: DataFrame, as_of, days: int = 7, n: int = 200) -> DataFrame:
    """The newest ``n`` joined rows first, and of those the ones with a state.

    The cut is a distributed top-n; no row has to be numbered for it.
    """
    departure = F.col("departure")
    today = F.date_trunc("day", at(as_of))
    recent = summaries.where(
        departure.startswith("Y") & (F.length(departure) >= 4)
        & (F.col("completion_time") >= today - F.make_interval(days=F.lit(days)))
    )
    order = [F.desc_nulls_first("completion_time"), F.asc("callsign"), F.asc("id"), F.asc("state"), F.asc("municipality")]
    top = join_airport_state(recent, airports).orderBy(*order).limit(n)
    return top.where(F.col("state").isNotNull()).select(
        "callsign", "cid", F.col("departure").alias("origin_airport"), "extracted_icao", "state", "municipality",
        "completion_time", "controller_time_percentage",
    )


# --- flight summaries -------------------------------------------------------

PERIODS = {"24h": {"hours": 24}, "7d": {"days": 7}, "30d": {"days": 30}, "all": None}


def _in_period(summaries: DataFrame, period: str, departure, arrival, as_of) -> DataFrame:
    span = PERIODS.get(period)
    if span:
        summaries = summaries.where(_since("completion_time", as_of, **span))
    if departure:
        summaries = summaries.where(F.col("departure") == departure.upper())
    if arrival:
        summaries = summaries.where(F.col("arrival") == arrival.upper())
    return summaries


def list_flight_summaries(
    summaries: DataFrame, departure=None, arrival=None, aircraft_type=None, flight_rules=None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of summaries, newest first."""
    rows = _listed(summaries, departure, arrival, aircraft_type, flight_rules)
    return rows.orderBy(F.desc_nulls_first("completion_time"), "id").offset(offset).limit(limit)


def _listed(summaries, departure, arrival, aircraft_type, flight_rules) -> DataFrame:
    rows = summaries
    for name, value in (("departure", departure), ("arrival", arrival), ("flight_rules", flight_rules)):
        if value:
            rows = rows.where(F.col(name) == value.upper())
    if aircraft_type:
        rows = rows.where(F.col("aircraft_type").ilike(f"%{aircraft_type}%"))
    return rows


def list_flight_summaries_total(
    summaries: DataFrame, departure=None, arrival=None, aircraft_type=None, flight_rules=None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """Number of matching summaries and whether a later page exists."""
    rows = _listed(summaries, departure, arrival, aircraft_type, flight_rules)
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"),
    )


def summary_status(summaries: DataFrame, as_of, time: str = "created_at") -> DataFrame:
    t = F.col(time)
    return summaries.agg(
        F.count(F.lit(1)).alias("total_summaries"),
        F.count_if(t >= ago(as_of, hours=24)).alias("last_24h"),
        F.count_if(t >= ago(as_of, hours=1)).alias("last_1h"),
        F.max(t).alias("last_processed"),
        F.coalesce(F.avg("time_online_minutes"), F.lit(0.0)).alias("avg_time_online_minutes"),
        F.coalesce(rounded_avg(F.col("controller_time_percentage"), 4), F.lit(0.0)).alias("avg_atc_coverage_percentage"),
    )


def summary_recent(summaries: DataFrame, n: int = 5) -> DataFrame:
    return summaries.orderBy(F.desc_nulls_first("completion_time"), "id").limit(n).select(
        "callsign", "departure", "arrival", "completion_time", "time_online_minutes"
    )


def summary_top_routes(summaries: DataFrame, as_of, period="24h", departure=None, arrival=None, n: int = 10) -> DataFrame:
    rows = _in_period(summaries, period, departure, arrival, as_of)
    return (
        rows.groupBy("departure", "arrival")
        .agg(
            F.count(F.lit(1)).alias("flight_count"),
            F.coalesce(F.avg("time_online_minutes"), F.lit(0.0)).alias("avg_time_online_minutes"),
            F.coalesce(rounded_avg(F.col("controller_time_percentage"), 4), F.lit(0.0)).alias("avg_atc_coverage_percentage"),
        )
        .orderBy(F.desc("flight_count"), "departure", "arrival")
        .limit(n)
    )


def summary_top_aircraft(summaries: DataFrame, as_of, period="24h", departure=None, arrival=None, n: int = 10) -> DataFrame:
    rows = _in_period(summaries, period, departure, arrival, as_of)
    return (
        rows.groupBy("aircraft_type")
        .agg(
            F.count(F.lit(1)).alias("flight_count"),
            F.coalesce(F.avg("time_online_minutes"), F.lit(0.0)).alias("avg_time_online_minutes"),
        )
        .orderBy(F.desc("flight_count"), "aircraft_type")
        .limit(n)
    )


def summary_coverage_bands(summaries: DataFrame, as_of, period="24h", departure=None, arrival=None) -> DataFrame:
    pct = F.col("controller_time_percentage")
    level = (
        F.when(pct == 0, "No ATC Contact")
        .when(pct <= 25, "Low ATC Contact (1-25%)")
        .when(pct <= 50, "Medium ATC Contact (26-50%)")
        .when(pct <= 75, "High ATC Contact (51-75%)")
        .otherwise("Full ATC Contact (76-100%)")
    )
    rows = _in_period(summaries, period, departure, arrival, as_of)
    return rows.groupBy(level.alias("coverage_level")).agg(F.count(F.lit(1)).alias("flight_count"))


def archive_completeness(archive: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null values per summary column and their mean, in one pass."""
    columns = columns or [
        "deptime", "controller_callsigns", "controller_time_percentage", "time_online_minutes",
        "primary_enroute_sector", "total_enroute_sectors", "total_enroute_time_minutes",
        "sector_breakdown", "completion_time",
    ]
    total = F.count(F.lit(1))
    rates = archive.agg(total.alias("total_records"), *[percent(F.count(c), total).alias(c) for c in columns])
    mean = sum((F.col(c).cast("decimal(7,2)") for c in columns), F.lit(0).cast("decimal(7,2)"))
    return rates.withColumn("overall_completion_percentage", rounded_ratio(mean, F.lit(len(columns)), 2))


def flights_by_cid_prefix(summaries: DataFrame, as_of, days: int = 7, averages: bool = False) -> DataFrame:
    group = F.floor(F.col("cid") / 100000)
    extra = []
    if averages:
        extra = [
            rounded_avg(F.col("time_online_minutes"), 1).alias("avg_flight_duration_minutes"),
            rounded_avg(F.col("controller_time_percentage"), 1).alias("avg_atc_contact_percentage"),
        ]
    return (
        summaries.where(_since("completion_time", as_of, days=days) & (group > 0))
        .groupBy(group.alias("cid_group"))
        .agg(F.count(F.lit(1)).alias("total_flights"), F.countDistinct("cid").alias("unique_pilots"), *extra)
    )


def _vfr(summaries: DataFrame) -> DataFrame:
    return summaries.where(
        (F.col("flight_rules") == "V") & nonblank(F.col("departure")) & nonblank(F.col("arrival"))
        & (F.col("departure") != F.col("arrival"))
    )


def _route_name() -> Column:
    return F.concat("departure", F.lit(" → "), "arrival")


def _vfr_means() -> list[Column]:
    return [
        rounded_avg(F.col("time_online_minutes"), 1).alias("avg_flight_duration_minutes"),
        rounded_avg(F.col("controller_time_percentage"), 1).alias("avg_atc_contact_percentage"),
    ]


def _vfr_routes(rows: DataFrame, pilots: str, flights: str, dates: bool) -> DataFrame:
    span = [F.min("completion_time").alias("first_flight_date"), F.max("completion_time").alias("last_flight_date")]
    return rows.groupBy("departure", "arrival").agg(
        F.countDistinct("callsign").alias(pilots),
        F.count(F.lit(1)).alias(flights),
        *_vfr_means(),
        *(span if dates else []),
    ).withColumn("route", _route_name())


def vfr_routes_by_pilots(summaries: DataFrame, least: int = 3, n: int = 25) -> DataFrame:
    rows = _vfr_routes(_vfr(summaries), "unique_pilots", "total_vfr_flights", True)
    return rows.where(F.col("unique_pilots") >= least).orderBy(
        F.desc("unique_pilots"), F.desc("total_vfr_flights"), "route"
    ).limit(n)


def vfr_routes_by_flights(summaries: DataFrame, least: int = 5, n: int = 20) -> DataFrame:
    rows = _vfr_routes(_vfr(summaries), "unique_pilots", "total_vfr_flights", True)
    return rows.where(F.col("total_vfr_flights") >= least).orderBy(
        F.desc("total_vfr_flights"), F.desc("unique_pilots"), "route"
    ).limit(n)


def vfr_routes_last_30_days(summaries: DataFrame, as_of, least: int = 2, n: int = 20) -> DataFrame:
    rows = _vfr(summaries).where(_since("completion_time", as_of, days=30))
    rows = _vfr_routes(rows, "unique_pilots_last_30_days", "vfr_flights_last_30_days", False)
    return rows.where(F.col("unique_pilots_last_30_days") >= least).orderBy(
        F.desc("unique_pilots_last_30_days"), F.desc("vfr_flights_last_30_days"), "route"
    ).limit(n)


def vfr_routes_by_aircraft(summaries: DataFrame, kind: str = "aircraft_short", least: int = 5, n: int = 15) -> DataFrame:
    rows = summaries.where((F.col("flight_rules") == "V") & nonblank(F.col(kind)))
    # concat skips NULL airports, as the text form of a route does
    route = F.concat(F.coalesce("departure", F.lit("")), F.lit(" → "), F.coalesce("arrival", F.lit("")))
    out = rows.groupBy(kind).agg(
        F.countDistinct("callsign").alias("unique_pilots"),
        F.count(F.lit(1)).alias("total_vfr_flights"),
        F.countDistinct(route).alias("unique_routes_flown"),
        *_vfr_means(),
    )
    return out.where(F.col("unique_pilots") >= least).orderBy(
        F.desc("unique_pilots"), F.desc("total_vfr_flights"), kind
    ).limit(n)


def vfr_routes_simple(summaries: DataFrame, as_of, least: int = 3, n: int = 10) -> DataFrame:
    rows = _vfr(summaries).where(_since("completion_time", as_of, days=30))
    out = _vfr_routes(rows, "unique_pilots", "total_vfr_flights", True).drop("departure", "arrival")
    return out.where(F.col("unique_pilots") >= least).orderBy(
        F.desc("unique_pilots"), F.desc("total_vfr_flights"), "route"
    ).limit(n)


def military_routes(summaries: DataFrame, as_of, types: Sequence[str], weeks: int = 1) -> DataFrame:
    """Flights of the listed types (whole codes) by route with their shares.

    The totals behind the shares are scalar sub-queries over the grouped
    counts, so no task holds all groups.
    """
    rows = summaries.where(
        F.col("aircraft_type").isin(*types) & _since("completion_time", as_of, weeks=weeks)
        & nonblank(F.col("departure")) & nonblank(F.col("arrival"))
    )
    grouped = rows.groupBy("departure", "arrival", "aircraft_type").agg(
        F.count(F.lit(1)).alias("total_flights"), F.countDistinct("cid").alias("unique_pilots")
    )
    def share(name: str) -> Column:
        return percent(F.col(name), grouped.agg(F.sum(name)).scalar())

    return grouped.withColumns(
        {
            "percentage_of_total_military_flights": share("total_flights"),
            "percentage_of_total_military_pilots": share("unique_pilots"),
        }
    )


def _categorised(summaries: DataFrame, as_of, months: int) -> DataFrame:
    """Recent summaries with their category.

    The long rule list runs once per distinct type, not once per flight; the
    list of types is small and joined back.
    """
    rows = summaries.where(
        nonblank(F.col("aircraft_type")) & (F.col("total_enroute_time_minutes") > 0)
        & _since("completion_time", as_of, months=months)
    )
    types = rows.select("aircraft_type").distinct()
    return rows.join(types.withColumn("aircraft_category", aircraft_category(F.col("aircraft_type"))), "aircraft_type")


def aircraft_categories(summaries: DataFrame) -> DataFrame:
    """Category of each aircraft type in use, with its number of flights.

    Types are grouped first, so the long rule list runs once per type.
    """
    types = summaries.where(nonblank(F.col("aircraft_type"))).groupBy("aircraft_type").agg(
        F.count(F.lit(1)).alias("flights")
    )
    return types.withColumn("aircraft_category", aircraft_category(F.col("aircraft_type")))


def popular_categories(summaries: DataFrame, as_of, months: int = 6) -> DataFrame:
    mean = F.round(
        F.try_divide(F.sum("controller_time_percentage").cast("decimal(22,2)"),
                     F.count("controller_time_percentage").cast("decimal(20,0)")), 1
    )
    return (
        _categorised(summaries, as_of, months)
        .groupBy(F.col("aircraft_category").alias("type"))
        .agg(
            F.count(F.lit(1)).alias("total_flights"),
            F.countDistinct("cid").alias("unique_pilots"),
            F.concat(mean.cast("decimal(10,1)").cast("string"), F.lit("%")).alias("avg_time_with_atc"),
        )
    )


def category_stats(summaries: DataFrame, as_of, months: int = 6) -> DataFrame:
    text = object_text(summaries, "controller_callsigns")
    has_map = text.isNotNull() & text.startswith("{") & (text != "{}")
    rows = _categorised(summaries, as_of, months).withColumn("_map", has_map)
    total = F.count(F.lit(1))
    # numeric division keeps 16 digits, so the mean of the ratios is exact enough
    ratio = F.try_divide(
        F.col("total_enroute_time_minutes").cast("decimal(12,0)"),
        F.nullif(F.col("time_online_minutes"), F.lit(0)).cast("decimal(12,0)"),
    ).cast("decimal(28,16)")
    return rows.groupBy("aircraft_category").agg(
        total.alias("total_flights"),
        F.countDistinct("aircraft_type").alias("unique_aircraft_types"),
        rounded_avg(F.col("total_enroute_time_minutes"), 1).alias("avg_flight_duration_minutes"),
        rounded_avg(F.col("time_online_minutes"), 1).alias("avg_time_online_minutes"),
        percent(F.count_if("_map"), total, 1).alias("percent_with_controllers"),
        F.round(F.avg(ratio.cast("double")), 2).alias("avg_efficiency_ratio"),
    )


# --- city pair --------------------------------------------------------------

# Fixed values of the city pair reports: airports, towers, distance in miles,
# fewest controllers and fewest ground controllers.
CITY_A, CITY_B = "YSSY", "YMML"
TOWER_A, TOWER_B = "SY_TWR", "ML_TWR"
PAIR_NM = 440
MIN_CONTROLLERS = 5
MIN_GROUND = 2


def _pair_speed(minutes: Column) -> Column:
    """Distance over hours, both divisions on whole numbers."""
    hours = F.floor(minutes / 60)
    return F.floor(F.lit(PAIR_NM) / F.nullif(hours, F.lit(0))).cast("double")


def _key_count(summaries: DataFrame) -> Column:
    return F.size(F.coalesce(object_keys(summaries, "controller_callsigns"), F.array().cast("array<string>")))


def _text_towers(summaries: DataFrame) -> tuple[Column, Column]:
    text = object_text(summaries, "controller_callsigns")
    return text.like(f"%{TOWER_A}%"), text.like(f"%{TOWER_B}%")


def fastest_city_pair(summaries: DataFrame, as_of, months: int = 3, n: int = 20) -> DataFrame:
    """Quickest flights from A to B that talked to both towers."""
    a, b = _text_towers(summaries)
    minutes = F.col("time_online_minutes")
    rows = summaries.where(
        (F.col("departure") == CITY_A) & (F.col("arrival") == CITY_B)
        & _since("completion_time", as_of, months=months) & (minutes > 0) & a & b
    )
    top = rows.orderBy("time_online_minutes", "id").limit(n)
    rank = F.row_number().over(W.orderBy("time_online_minutes", "id"))
    return top.select(
        rank.cast("long").alias("rank"), "callsign", F.col("name").alias("pilot_name"), "aircraft_type", "departure", "arrival",
        F.col("logon_time").alias("departure_time"), F.col("completion_time").alias("arrival_time"),
        minutes.alias("flight_duration_minutes"), _key_count(summaries).cast("long").alias("total_controllers"),
        _pair_speed(minutes).alias("avg_speed_knots"),
    )


def _day_before(as_of) -> tuple[Column, Column]:
    today = F.date_trunc("day", at(as_of))
    return today - F.make_interval(days=F.lit(1)), today


def fastest_city_pair_day(summaries: DataFrame, as_of) -> DataFrame:
    """A-B flights of any day, and the B-A flights of the day before with both
    towers and five controllers: AND binds before OR in this filter."""
    a, b = _text_towers(summaries)
    minutes = F.col("time_online_minutes")
    start, end = _day_before(as_of)
    keys = _key_count(summaries)
    status = (
        F.when(a & b, "Both Towers").when(a, "Sydney Only").when(b, "Melbourne Only").otherwise("No Tower Contact")
    )
    there = (F.col("departure") == CITY_A) & (F.col("arrival") == CITY_B)
    back = (
        (F.col("departure") == CITY_B) & (F.col("arrival") == CITY_A)
        & (F.col("completion_time") >= start) & (F.col("completion_time") < end)
        & (minutes > 0) & a & b & (keys >= MIN_CONTROLLERS)
    )
    return summaries.where(there | back).select(
        "callsign", "aircraft_type", F.col("name").alias("pilot_name"), "departure", "arrival",
        F.col("logon_time").alias("departure_time"), F.col("completion_time").alias("arrival_time"),
        minutes.alias("flight_duration_minutes"), "flight_rules", keys.cast("long").alias("total_controllers"),
        F.when(minutes > 0, _pair_speed(minutes)).alias("avg_speed_knots"), status.alias("tower_contact_status"),
        object_text(summaries, "controller_callsigns").alias("controller_callsigns"),
    )


def city_pair_stats(summaries: DataFrame, as_of, days: int = 1) -> DataFrame:
    """Counts and times of the day before, both directions, both towers."""
    a, b = _text_towers(summaries)
    minutes = F.col("time_online_minutes")
    _, end = _day_before(as_of)
    start = end - F.make_interval(days=F.lit(days))
    there = (F.col("departure") == CITY_A) & (F.col("arrival") == CITY_B)
    back = (F.col("departure") == CITY_B) & (F.col("arrival") == CITY_A)
    rows = summaries.where(
        (there | back) & (F.col("completion_time") >= start) & (F.col("completion_time") < end)
        & (minutes > 0) & a & b & (_key_count(summaries) >= MIN_CONTROLLERS)
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total_flights_both_towers"),
        F.count_if(F.col("departure") == CITY_A).alias("sydney_to_melbourne_both_towers"),
        F.count_if(F.col("departure") == CITY_B).alias("melbourne_to_sydney_both_towers"),
        rounded_avg(minutes, 1).alias("avg_flight_duration_minutes"),
        F.min(minutes).cast("double").alias("fastest_flight_minutes"),
        F.max(minutes).cast("double").alias("slowest_flight_minutes"),
        rounded_avg(_pair_speed(minutes).cast("long"), 1).alias("avg_speed_knots"),
    )


def _monday(summaries: DataFrame, as_of, months: int) -> DataFrame:
    keys = object_keys(summaries, "controller_callsigns")
    ground = F.size(F.filter(keys, lambda k: k.contains("GND")))
    return summaries.where(
        (F.col("departure") == CITY_B) & (F.col("arrival") == CITY_A)
        & _since("completion_time", as_of, months=months) & (F.dayofweek("completion_time") == 2)
        & (F.col("total_enroute_time_minutes") > 0) & F.col("controller_callsigns").isNotNull()
    ).withColumns({"_keys": keys, "_ground": ground}).where(
        F.array_contains("_keys", TOWER_A) & F.array_contains("_keys", TOWER_B) & (F.col("_ground") >= MIN_GROUND)
    )


def fastest_city_pair_monday(summaries: DataFrame, as_of, months: int = 6, n: int = 20) -> DataFrame:
    minutes = F.col("total_enroute_time_minutes")
    top = _monday(summaries, as_of, months).orderBy("total_enroute_time_minutes", "id").limit(n)
    rank = F.row_number().over(W.orderBy("total_enroute_time_minutes", "id"))
    return top.select(
        rank.cast("long").alias("rank"), "callsign", F.col("name").alias("pilot_name"), "aircraft_type", "departure", "arrival",
        F.col("logon_time").alias("departure_time"), F.col("completion_time").alias("arrival_time"),
        minutes.alias("flight_duration_minutes"), F.lit("Monday").alias("completion_day_name"),
        F.lit(True).alias("contacted_sydney_tower"), F.lit(True).alias("contacted_melbourne_tower"),
        F.col("_ground").cast("long").alias("ground_controllers_contacted"), F.size("_keys").cast("long").alias("total_controllers"),
        _pair_speed(minutes).alias("avg_speed_knots"),
    )


def city_pair_monday_stats(summaries: DataFrame, as_of, months: int = 6) -> DataFrame:
    minutes = F.col("total_enroute_time_minutes")
    return _monday(summaries, as_of, months).agg(
        F.count(F.lit(1)).alias("total_monday_flights"),
        rounded_avg(minutes, 1).alias("avg_flight_time_minutes"),
        F.min(minutes).alias("fastest_flight_minutes"),
        F.max(minutes).alias("slowest_flight_minutes"),
        F.round(F.stddev_samp(minutes), 1).alias("std_dev_minutes"),
        rounded_avg(F.size("_keys"), 1).alias("avg_controllers_contacted"),
        F.countDistinct("aircraft_type").alias("unique_aircraft_types"),
    )
