"""Management reports that were specified over the flight summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from airtrace.functions.callsign import contact_type
from airtrace.functions.exact import percent, rounded_avg, rounded_ratio
from airtrace.functions.values import ago, at, nonblank, object_keys
from airtrace.operators.ordered import neighbour
from airtrace.plans.contact_reports import overall_atc_statistics

# Flight rules letter of IFR and the altitude that counts as airborne.
IFR = "I"
AIRBORNE_FEET = 1500


def _ifr(summaries: DataFrame) -> DataFrame:
    return summaries.where(F.col("flight_rules") == IFR)


def _n_keys(summaries: DataFrame) -> Column:
    return F.size(F.coalesce(object_keys(summaries, "controller_callsigns"), F.array().cast("array<string>")))


def report_ifr_coverage(summaries: DataFrame) -> DataFrame:
    contact = F.count_if(F.col("controller_time_percentage") > 0)
    return _ifr(summaries).agg(
        F.count(F.lit(1)).alias("ifr_flights"), contact.alias("ifr_flights_with_contact"),
        percent(contact, F.count(F.lit(1))).alias("ifr_coverage_percentage"),
    )


def report_interactions_per_ifr(summaries: DataFrame) -> DataFrame:
    """Histogram of distinct controllers per IFR flight with the overall mean."""
    per_flight = _ifr(summaries).select(_n_keys(summaries).cast("long").alias("controllers"))
    histogram = per_flight.groupBy("controllers").agg(F.count(F.lit(1)).alias("flights"))
    flights = F.col("flights")
    mean = histogram.agg(rounded_ratio(F.sum(F.col("controllers") * flights), F.sum(flights), 2)).scalar()
    return histogram.withColumn("avg_controllers_per_flight", mean)


def _types(summaries: DataFrame) -> DataFrame:
    """(flight id, controller type): each type once per flight."""
    kinds = F.array_distinct(F.transform(object_keys(summaries, "controller_callsigns"), contact_type))
    return summaries.select("id", "time_online_minutes", F.explode(kinds).alias("controller_type"))


def report_coverage_by_type(summaries: DataFrame) -> DataFrame:
    """Flights that talked to each controller type, as a share of all flights."""
    total = summaries.agg(F.count(F.lit(1))).scalar()
    return _types(summaries).groupBy("controller_type").agg(F.count(F.lit(1)).alias("flights")).withColumn(
        "coverage_percentage", percent(F.col("flights"), total)
    )


def report_workload(summaries: DataFrame) -> DataFrame:
    """Share of all contacts that each controller type handled."""
    contacts = summaries.select(F.explode(object_keys(summaries, "controller_callsigns")).alias("key"))
    per_type = contacts.groupBy(contact_type(F.col("key")).alias("controller_type")).agg(F.count(F.lit(1)).alias("contacts"))
    total = per_type.agg(F.sum("contacts")).scalar()
    return per_type.withColumn("workload_percentage", percent(F.col("contacts"), total))


def report_hourly_traffic(summaries: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Flights on line per hour of the last days, by controller type."""
    start, end = F.date_trunc("hour", F.col("logon_time")), F.date_trunc("hour", F.col("completion_time"))
    kinds = F.array_distinct(F.transform(object_keys(summaries, "controller_callsigns"), contact_type))
    rows = summaries.where(
        (F.col("completion_time") >= ago(as_of, days=days)) & (F.col("logon_time") <= at(as_of)) & (start <= end)
    )
    # only hours inside the report are listed, so a long flight has few rows
    first = F.greatest(start, F.date_trunc("hour", ago(as_of, days=days)))
    last = F.least(end, at(as_of))
    hours = F.explode(F.sequence(first, last, F.expr("interval 1 hour")))
    listed = rows.select(hours.alias("hour"), kinds.alias("kinds"))
    return listed.select("hour", F.explode_outer("kinds").alias("controller_type")).groupBy("hour", "controller_type").agg(
        F.count(F.lit(1)).alias("flights")
    )


def concurrent_peak(spans: DataFrame, start: str, end: str, chunk_hours: int = 24) -> DataFrame:
    """Largest number of spans open at once, and the first second it is reached.

    Starts count +1 and ends -1 (an end second still counts as open). Changes
    are summed per second, then running sums are built per time chunk, and one
    row per chunk carries the level over, so no task sorts all rows.
    """
    open_ = F.unix_seconds(F.col(start).cast("timestamp"))
    shut = F.unix_seconds(F.col(end).cast("timestamp")) + 1
    known = spans.where(F.col(start) <= F.col(end))
    steps = known.select(F.explode(F.array(
        F.struct(open_.alias("s"), F.lit(1).alias("d")), F.struct(shut.alias("s"), F.lit(-1).alias("d"))
    )).alias("e")).select("e.s", "e.d")
    per_second = steps.groupBy("s").agg(F.sum("d").alias("d")).withColumn(
        "chunk", F.floor(F.col("s") / (chunk_hours * 3600))
    )
    inside = per_second.withColumn("level", F.sum("d").over(W.partitionBy("chunk").orderBy("s")))
    best = F.max_by(F.struct("level", "s"), F.struct("level", -F.col("s")))
    chunks = inside.groupBy("chunk").agg(best.alias("b"), F.sum("d").alias("net"))
    # one row per day of data
    before = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    lifted = chunks.select(
        (F.col("b.level") + F.coalesce(F.sum("net").over(before), F.lit(0))).alias("level"), F.col("b.s").alias("s")
    )
    return lifted.agg(
        F.max("level").alias("peak"),
        F.timestamp_seconds(F.max_by("s", F.struct("level", -F.col("s")))).alias("peak_time"),
    )


def report_peak_load(summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Peak of concurrent IFR flights beside that of enroute controllers."""
    flights = concurrent_peak(_ifr(summaries), "logon_time", "completion_time")
    enroute = sessions.where(F.col("callsign").endswith("CTR") | F.col("callsign").endswith("FSS"))
    controllers = concurrent_peak(enroute, "session_start_time", "session_end_time")
    return flights.select(F.lit("ifr_flights").alias("kind"), "*").unionByName(
        controllers.select(F.lit("enroute_controllers").alias("kind"), "*")
    )


def report_aircraft_mix(summaries: DataFrame) -> DataFrame:
    return summaries.where(nonblank(F.col("aircraft_type"))).groupBy("aircraft_type").agg(
        F.count(F.lit(1)).alias("flights"),
        rounded_avg(F.col("time_online_minutes"), 1).alias("avg_duration_minutes"),
    )


def report_route_performance(summaries: DataFrame, n: int = 10) -> DataFrame:
    rows = summaries.where(nonblank(F.col("departure")) & nonblank(F.col("arrival")))
    return rows.groupBy("departure", "arrival").agg(
        F.count(F.lit(1)).alias("flights"),
        rounded_avg(F.col("controller_time_percentage"), 1).alias("avg_coverage_percentage"),
    ).orderBy(F.desc("flights"), "departure", "arrival").limit(n)


def report_flow(summaries: DataFrame) -> DataFrame:
    """Flights per origin and destination."""
    rows = summaries.where(nonblank(F.col("departure")) & nonblank(F.col("arrival")))
    return rows.groupBy("departure", "arrival").agg(F.count(F.lit(1)).alias("flights"))


def report_sector_transitions(stays: DataFrame) -> DataFrame:
    """Moves from one sector to the next of the same aircraft."""
    named = stays.select("callsign", "entry_timestamp", F.col("sector_name").alias("from_sector"))
    moves = neighbour(named, "callsign", "entry_timestamp", "from_sector", "to_sector", back=False, ties=["from_sector"])
    return moves.where("to_sector is not null").groupBy("from_sector", "to_sector").agg(
        F.count(F.lit(1)).alias("transitions")
    )


def report_ifr_duration(summaries: DataFrame) -> DataFrame:
    """Mean, median and spread of IFR flight times in hourly classes.

    The exact median comes from a count per minute value, so no task holds all
    flight times.
    """
    minutes = F.col("time_online_minutes")
    counts = _ifr(summaries).where(minutes.isNotNull()).groupBy(minutes.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(
        F.sum("n").alias("flights"),
        rounded_ratio(F.sum(F.col("m") * F.col("n")), F.sum("n"), 1).alias("mean_minutes"),
        F.expr("percentile(m, 0.5, n)").alias("median_minutes"),
        *[
            F.coalesce(F.sum(F.when((F.col("m") >= a) & (F.col("m") < b), F.col("n"))), F.lit(0)).alias(name)
            for name, a, b in (("under_1h", -1 << 30, 60), ("from_1h", 60, 120), ("from_2h", 120, 240), ("from_4h", 240, 480), ("from_8h", 480, 1 << 30))
        ],
    )
    return stats


def report_airborne_contact(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    """The overall contact share of rows above 1500 ft."""
    return overall_atc_statistics(flights.where(F.col("altitude") > AIRBORNE_FEET), transceivers, controllers, **kw)


def report_system_kpis(summaries: DataFrame) -> DataFrame:
    done = F.count_if(F.col("completion_time").isNotNull() & nonblank(F.col("arrival")))
    return summaries.agg(
        F.count(F.lit(1)).alias("total_flights"),
        percent(done, F.count(F.lit(1))).alias("completion_rate"),
        rounded_avg(F.col("controller_time_percentage"), 2).alias("avg_coverage_percentage"),
        rounded_avg(F.col("time_online_minutes"), 1).alias("avg_duration_minutes"),
    )
