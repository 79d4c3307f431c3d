"""Reports over controller rows and controller summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from airtrace.functions.callsign import SESSION_ORDER, position_type
from airtrace.functions.exact import rounded_avg, rounded_ratio
from airtrace.functions.values import ago, object_keys, upto
from airtrace.plans.flight_reports import latest_rows_by
from airtrace.session import materialise
from airtrace.sources import tables

HANDLED = "total_aircraft_handled"
MINUTES = "session_duration_minutes"


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _mean(name: str) -> Column:
    return F.coalesce(F.avg(name), F.lit(0.0))


def list_controller_summaries(
    summaries: DataFrame, callsign: str | None = None, date_from: Column | None = None,
    date_to: Column | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of sessions, newest first."""
    rows = summaries
    if callsign:
        rows = rows.where(F.col("callsign").ilike(f"%{callsign}%"))
    if date_from is not None:
        rows = rows.where(F.col("session_start_time") >= date_from)
    if date_to is not None:
        rows = rows.where(F.col("session_end_time") <= date_to)
    return rows.orderBy(F.desc_nulls_first("session_start_time"), "id").offset(offset).limit(limit)


def controller_stats(summaries: DataFrame, callsign: str | None = None) -> DataFrame:
    rows = summaries if callsign is None else summaries.where(F.col("callsign") == callsign)
    return rows.groupBy("callsign").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        _mean(MINUTES).alias("avg_session_duration_minutes"),
        _sum(HANDLED).alias("total_aircraft_handled"),
        F.coalesce(F.max("peak_aircraft_count"), F.lit(0)).alias("max_peak_aircraft"),
        F.min("session_start_time").alias("first_session"),
        F.max("session_start_time").alias("last_session"),
    )


def performance_overview(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.count(F.lit(1)).alias("total_summaries"),
        _mean(MINUTES).alias("avg_session_duration_minutes"),
        _sum(HANDLED).alias("total_aircraft_handled"),
        _mean(HANDLED).alias("avg_aircraft_per_session"),
        F.coalesce(F.max("peak_aircraft_count"), F.lit(0)).alias("max_peak_aircraft"),
        F.countDistinct("callsign").alias("unique_controllers"),
        F.min("session_start_time").alias("earliest_session"),
        F.max("session_start_time").alias("latest_session"),
    )


def dashboard_recent(summaries: DataFrame, n: int = 10) -> DataFrame:
    return summaries.orderBy(F.desc_nulls_first("session_start_time"), "id").limit(n).select(
        "callsign", F.col("session_start_time").alias("session_start"), F.col(MINUTES).alias("duration_minutes"),
        F.col(HANDLED).alias("aircraft_handled"), F.col("peak_aircraft_count").alias("peak_aircraft"),
    )


def dashboard_top(summaries: DataFrame, n: int = 5) -> DataFrame:
    return summaries.groupBy("callsign").agg(
        F.count(F.lit(1)).alias("sessions"), _sum(HANDLED).alias("total_aircraft"),
        _mean(MINUTES).alias("avg_duration_minutes"),
    ).orderBy(F.desc("total_aircraft"), "callsign").limit(n)


def positions_by_cid(controllers: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Newest position per callsign, gathered per controller id.

    The list holds one entry per callsign of the id, not one per stored row.
    """
    newest = latest_rows_by(
        upto(controllers, "last_updated", as_of), "callsign", "last_updated", ["callsign", "cid", "facility", "logon_time"], ago(as_of, hours=hours)
    )
    entry = F.struct("callsign", "facility", "logon_time")
    return newest.groupBy("cid").agg(F.sort_array(F.collect_list(entry)).alias("positions"))


# --- weekly statistics from the flight summaries -----------------------------


def controller_weekly_stats(summaries: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per controller key of the week's flights: callsigns, flights, last time."""
    recent = summaries.where(F.col("completion_time") >= ago(as_of, days=days))
    keys = recent.select(
        F.explode(object_keys(recent, "controller_callsigns")).alias("controller_callsign"), "callsign", "completion_time"
    )
    return keys.groupBy("controller_callsign").agg(
        F.countDistinct("callsign").alias("unique_flights_handled"),
        F.max("completion_time").alias("last_flight_time"),
        F.count(F.lit(1)).alias("total_interactions"),
    )


def day_states(summaries: DataFrame) -> DataFrame:
    """What a week's statistics need of each day: per date, controller and flight its entries and last time."""
    rows = summaries.where(F.col("completion_time").isNotNull())
    keys = rows.select(
        F.to_date("completion_time").alias("day"), "completion_time", "callsign",
        F.explode(object_keys(rows, "controller_callsigns")).alias("controller_callsign"))
    return keys.groupBy("day", "controller_callsign", "callsign").agg(
        F.count(F.lit(1)).alias("interactions"), F.max("completion_time").alias("last_flight_time"))


def refresh_day_states(spark: SparkSession, store: str) -> tables.Version:
    """Bring the stored day states up to the summaries of a store.

    Only runs that have added summaries since the last refresh are looked at,
    and only the days they touch are computed again; the other days of a month
    are carried over as they are. A repeat changes nothing.
    """
    now = tables.latest(spark, store)
    entries = now.of("flight_summaries")
    known = set(now.marks.get("day-states", "").split(","))
    new = [e for e in entries if e.run not in known]
    if not new:
        return now
    days = [r.day for r in tables.read(spark, store, "flight_summaries", now, new).where(
        "completion_time is not null").select(F.to_date("completion_time").alias("day")).distinct().collect()]
    months = {e.part for e in new}
    rows = tables.read(spark, store, "flight_summaries", now, [e for e in entries if e.part in months])
    states = day_states(rows.where(F.to_date("completion_time").isin(days)))
    old = [e for e in now.of("controller_days") if e.part in months]
    if old:
        kept = tables.read(spark, store, "controller_days", now, old).where(~F.col("day").isin(days))
        states = states.unionByName(kept)
    made, _ = tables.stage(states, store, "controller_days", f"days-{now.number}", "last_flight_time", grain="month")
    runs = ",".join(sorted({e.run for e in entries}))
    return tables.publish(spark, store, tables.Change("day-states", runs, tuple(made), tuple(old), {"controller_days": states.schema}))


def controller_weekly_stored(spark: SparkSession, store: str, as_of, days: int = 7) -> DataFrame:
    """``controller_weekly_stats`` from stored day states.

    Whole days come from their states; of the day the window begins in, only its
    later summaries count, so that one day is read itself.
    """
    start = ago(as_of, days=days)
    first, month = spark.range(1).select(*[
        d.cast("string") for d in (F.to_date(start), F.to_date(F.date_trunc("month", start)))]).first()
    now = tables.latest(spark, store)
    whole = tables.read(spark, store, "controller_days", now, since=month).where(F.col("day") > F.lit(first).cast("date"))
    edge = tables.read(spark, store, "flight_summaries", now, since=month, until=month).where(
        (F.col("completion_time") >= start) & (F.to_date("completion_time") == F.lit(first).cast("date")))
    return whole.unionByName(day_states(edge)).groupBy("controller_callsign").agg(
        F.countDistinct("callsign").alias("unique_flights_handled"),
        F.max("last_flight_time").alias("last_flight_time"),
        F.sum("interactions").alias("total_interactions"),
    )


def _recent_controllers(controllers: DataFrame, as_of, days: int, ratings=None) -> DataFrame:
    rows = controllers.where(F.col("last_updated") >= ago(as_of, days=days))
    if ratings:
        rows = rows.where(F.col("rating").isin(*ratings))
    return rows.select("callsign", "name", "rating")


def flights_per_controller(controllers: DataFrame, summaries: DataFrame, as_of, as_of_flights=None) -> DataFrame:
    """Distinct flights of the week whose map names the controller.

    One row per stored controller row; the counts are one row per controller.
    """
    weekly = controller_weekly_stats(summaries, as_of_flights or as_of)
    rows = _recent_controllers(controllers, as_of, 7, (2, 3))
    return rows.join(weekly, F.col("callsign") == F.col("controller_callsign"), "left").select(
        "callsign", "name", "rating",
        F.coalesce("unique_flights_handled", F.lit(0)).alias("unique_flights_handled"),
    )


def controller_weekly_join(controllers: DataFrame, weekly: DataFrame, as_of) -> DataFrame:
    rows = _recent_controllers(controllers, as_of, 7)
    return rows.join(weekly, F.col("callsign") == F.col("controller_callsign"), "left").select(
        "callsign", "name", "rating",
        F.coalesce("unique_flights_handled", F.lit(0)).alias("weekly_flights"),
        F.coalesce("total_interactions", F.lit(0)).alias("weekly_interactions"),
        "last_flight_time",
    )


def controllers_no_activity(controllers: DataFrame, weekly: DataFrame, as_of) -> DataFrame:
    rows = _recent_controllers(controllers, as_of, 7)
    quiet = weekly.where(F.coalesce("unique_flights_handled", F.lit(0)) > 0)
    return rows.join(quiet, F.col("callsign") == F.col("controller_callsign"), "left_anti").select(
        "callsign", "name", "rating"
    )


def flights_per_controller_radio(
    controllers: DataFrame, flights: DataFrame, transceivers: DataFrame, as_of, n: int = 5
) -> DataFrame:
    """Distinct flights that share a frequency with the controller, top ``n``.

    Callsigns of the week's aircraft are numbered, and a frequency's aircraft
    are exact bitmaps over blocks of numbers. A controller's frequencies are
    united block by block and their bits counted, so a busy frequency costs a
    bit per callsign, and no pair of callsigns is ever made.
    """
    week = ago(as_of, days=7)
    staff = controllers.where((F.col("last_updated") >= week) & F.col("rating").isin(2, 3)).select(
        "callsign", "name", "rating"
    ).distinct()
    seen = flights.where((F.col("last_updated") >= week) & F.col("callsign").isNotNull()).select("callsign").distinct()
    # written once: the numbers must be the same for all of a callsign's frequencies
    numbered = materialise(seen.withColumn("_no", F.monotonically_increasing_id()), "callsigns")
    kind = F.col("entity_type")
    aircraft = transceivers.where(kind == "flight").select("callsign", "frequency").distinct().join(numbered, "callsign")
    heard = aircraft.groupBy("frequency", F.bitmap_bucket_number("_no").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_no")).alias("bits"))
    atc = transceivers.where(kind == "atc").select("callsign", "frequency").distinct()
    atc = atc.join(staff.select("callsign"), "callsign", "left_semi")
    united = atc.join(heard, "frequency").groupBy("callsign", "block").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    handled = united.groupBy("callsign").agg(F.sum("n").alias("unique_flights_handled"))
    return staff.join(handled, "callsign").orderBy(
        F.desc("unique_flights_handled"), "callsign", "name", "rating"
    ).limit(n)


# --- sessions -----------------------------------------------------------------


def controllers_by_rank_group(summaries: DataFrame, as_of, weeks: int = 1) -> DataFrame:
    rating = F.col("rating")
    group = (
        F.when(rating == 1, "Rank 1").when(rating == 2, "S1").when(rating == 3, "S2").when(rating == 4, "S3")
        .when(rating >= 5, "C1+").otherwise("Unknown")
    )
    rows = summaries.where((F.col("session_start_time") >= ago(as_of, weeks=weeks)) & (F.col(HANDLED) > 0))
    return rows.groupBy(group.alias("rank_group")).agg(F.countDistinct("name").alias("unique_controllers"))


def _hours() -> Column:
    """Whole hours of a session, NULL for less than one."""
    return F.nullif(F.floor(F.col(MINUTES) / 60), F.lit(0))


def _recent_sessions(summaries: DataFrame, as_of, months: int) -> DataFrame:
    return summaries.where((F.col(MINUTES) > 0) & (F.col("session_start_time") >= ago(as_of, months=months)))


def session_stats_by_type(summaries: DataFrame, as_of, months: int = 1, fss_ctr_only: bool = False) -> DataFrame:
    rows = _recent_sessions(summaries, as_of, months)
    order = SESSION_ORDER
    if fss_ctr_only:
        order = ("FSS", "CTR")
        rows = rows.where(F.col("callsign").contains("FSS") | F.col("callsign").contains("CTR"))
    # the per-session ratio keeps 16 digits, as numeric division does
    per_hour = F.try_divide(F.col(HANDLED).cast("decimal(12,0)"), _hours().cast("decimal(12,0)")).cast("double")
    return rows.groupBy(position_type(F.col("callsign"), order).alias("controller_type")).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        rounded_avg(F.col(MINUTES), 1).alias("avg_session_duration_minutes"),
        F.min(MINUTES).alias("shortest_session_minutes"),
        F.max(MINUTES).alias("longest_session_minutes"),
        F.round(F.stddev_samp(MINUTES), 1).alias("std_dev_minutes"),
        rounded_avg(F.col(HANDLED), 1).alias("avg_aircraft_handled"),
        F.min(HANDLED).alias("min_aircraft_handled"),
        F.max(HANDLED).alias("max_aircraft_handled"),
        rounded_avg(F.col("peak_aircraft_count"), 1).alias("avg_peak_aircraft"),
        F.round(F.avg(per_hour), 1).alias("avg_efficiency_aircraft_per_hour"),
    )


def _longest(rows: DataFrame, n: int) -> DataFrame:
    """Top ``n`` by duration. The rank equals the sort order, so the rows are
    cut by a distributed top-n first and only ``n`` rows are numbered."""
    top = rows.orderBy(F.desc(MINUTES), "id").limit(n)
    rank = F.row_number().over(W.orderBy(F.desc(MINUTES), "id"))
    return top.select(
        rank.cast("long").alias("duration_rank"), "callsign", F.col("name").alias("controller_name"), "cid", "rating",
        "session_start_time", "session_end_time", MINUTES, HANDLED, "peak_aircraft_count",
        rounded_ratio(F.col(HANDLED), _hours(), 1).alias("avg_aircraft_per_hour"),
        *[c for c in ("facility", "server", "frequencies_used", "aircraft_details") if c in rows.columns],
    )


def longest_sessions(summaries: DataFrame, as_of, months: int = 1, n: int = 20) -> DataFrame:
    return _longest(_recent_sessions(summaries, as_of, months), n)


def longest_fss_ctr(summaries: DataFrame, as_of, months: int = 1, n: int = 20) -> DataFrame:
    """FSS sessions of any time and CTR sessions of the period: AND binds first."""
    recent = (F.col(MINUTES) > 0) & (F.col("session_start_time") >= ago(as_of, months=months))
    rows = summaries.where(F.col("callsign").contains("FSS") | (F.col("callsign").contains("CTR") & recent))
    return _longest(rows.where(F.col(MINUTES) > 0), n)


def topk_sessions_r1to3(summaries: DataFrame, k: int = 5) -> DataFrame:
    rows = summaries.where(F.col("rating").isin(1, 2, 3) & (F.col(HANDLED) > 0))
    return rows.orderBy(F.desc(HANDLED), "id").limit(k).select(
        F.col("callsign").alias("controller_callsign"), F.col("name").alias("controller_name"),
        F.col(HANDLED).alias("unique_flights_handled"), MINUTES, "session_start_time",
    )


def _by_name(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where(F.col(HANDLED) > 0).groupBy(F.col("name").alias("controller_name"), *keys).agg(
        F.sum(HANDLED).alias("total_flights_handled"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg(MINUTES).alias("avg_session_duration_minutes"),
        F.sum(MINUTES).alias("_minutes"),
        rounded_avg(F.col(HANDLED), 0).alias("_avg"),
    )


def topk_r5plus_sessions(summaries: DataFrame, k: int = 5) -> DataFrame:
    rows = _by_name(summaries.where(F.col("rating") >= 5)).drop("_minutes", "_avg")
    return rows.orderBy(F.desc("total_flights_handled"), "controller_name").limit(k)


def topk_r1to3_hours(summaries: DataFrame, k: int = 5) -> DataFrame:
    rows = _by_name(summaries.where(F.col("rating").isin(1, 2, 3)))
    return rows.select(
        "controller_name", rounded_ratio(F.col("_minutes"), F.lit(60), 0).alias("total_time_online_hours"),
        "total_sessions", F.col("_avg").alias("avg_aircraft_per_session"),
    ).orderBy(F.desc("total_time_online_hours"), "controller_name").limit(k)


def topk_r5to12_flights(summaries: DataFrame, as_of, weeks: int = 1, k: int = 10) -> DataFrame:
    recent = summaries.where(
        (F.col("session_start_time") >= ago(as_of, weeks=weeks)) & F.col("rating").between(5, 12)
    )
    rows = _by_name(recent, "rating").select(
        "controller_name", F.col("rating").alias("controller_rating"), "total_flights_handled", "total_sessions"
    )
    return rows.orderBy(F.desc("total_flights_handled"), "controller_name", "controller_rating").limit(k)


def topk_ctr_fss(summaries: DataFrame, k: int = 5) -> DataFrame:
    ends = F.col("callsign").endswith("CTR") | F.col("callsign").endswith("FSS")
    rows = _by_name(summaries.where(ends)).drop("_minutes", "_avg")
    return rows.orderBy(F.desc("total_flights_handled"), "controller_name").limit(k)


def integrity_statistics(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.count(F.lit(1)).alias("total_summaries"),
        F.countDistinct("callsign").alias("unique_controllers"),
        F.avg(MINUTES).alias("avg_duration"),
        F.min(MINUTES).alias("min_duration"),
        F.max(MINUTES).alias("max_duration"),
        F.avg(HANDLED).alias("avg_aircraft"),
        F.sum(HANDLED).alias("total_aircraft_handled"),
    )
