"""Data quality rules, each table checked in one pass."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airtrace.functions.exact import percent
from airtrace.functions.values import ago, at
from airtrace.operators.ordered import neighbour
from airtrace.sources import tables as stored

# The range rules of the stored tables.
RULES: dict[str, dict[str, str]] = {
    "controllers": {
        "valid_rating": "rating >= -1 and rating <= 12",
        "valid_facility": "facility >= 0 and facility <= 6",
        "valid_visual_range": "visual_range >= 0",
    },
    "flights": {
        "valid_latitude": "latitude >= -90 and latitude <= 90",
        "valid_longitude": "longitude >= -180 and longitude <= 180",
        "valid_altitude": "altitude >= -1000 and altitude <= 100000",
        "valid_heading": "heading >= 0 and heading <= 360",
        "valid_groundspeed": "groundspeed >= 0",
        "valid_pilot_rating": "pilot_rating >= 0 and pilot_rating <= 63",
    },
    "transceivers": {
        "valid_frequency": "frequency >= 0",
        "valid_entity_type": "entity_type in ('flight', 'atc')",
    },
    "controller_summaries": {
        "valid_aircraft_counts": "total_aircraft_handled >= 0 and peak_aircraft_count >= 0 and peak_aircraft_count <= total_aircraft_handled",
        "valid_session_times": "session_end_time is null or session_end_time > session_start_time",
        "valid_rating": "rating >= 1 and rating <= 11",
    },
    "flight_summaries": {
        "valid_controller_time": "controller_time_percentage >= 0 and controller_time_percentage <= 100",
        "valid_airborne_time": "airborne_controller_time_percentage >= 0 and airborne_controller_time_percentage <= 100",
        "valid_time_online": "time_online_minutes >= 0",
        "valid_total_enroute_sectors": "total_enroute_sectors >= 0",
        "valid_total_enroute_time": "total_enroute_time_minutes >= 0",
    },
    "flight_sector_occupancy": {
        "valid_duration": "duration_seconds >= 0",
        "valid_entry_lat": "entry_lat >= -90 and entry_lat <= 90",
        "valid_entry_lon": "entry_lon >= -180 and entry_lon <= 180",
        "valid_exit_lat": "exit_lat >= -90 and exit_lat <= 90",
        "valid_exit_lon": "exit_lon >= -180 and exit_lon <= 180",
    },
}


def _unpivot(row: DataFrame, label: str, value: str) -> DataFrame:
    return row.unpivot([], row.columns, label, value)


def _columns_of(rule: str) -> set[str]:
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", rule)))
    return words - {"and", "or", "in", "is", "null", "not"}


def dq_constraints(table: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows that break each rule. A rule that is NULL is not broken.

    A rule on columns the table lacks cannot be checked; it is listed with a
    null number.
    """
    known = {name: rule for name, rule in rules.items() if _columns_of(rule) <= set(table.columns)}
    counts = table.agg(*[
        F.count_if(~F.expr(f"({rule})")).alias(name) if name in known else F.lit(None).cast("bigint").alias(name)
        for name, rule in rules.items()
    ])
    return _unpivot(counts, "rule", "violations")


def dq_all_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rules of every given table, one row per rule."""
    out = None
    for name, df in tables.items():
        part = dq_constraints(df, RULES[name]).select(F.lit(name).alias("table_name"), "rule", "violations")
        out = part if out is None else out.unionByName(part)
    return out


REQUIRED = ("callsign", "latitude", "longitude", "altitude", "groundspeed", "heading")


def dq_completeness(flights: DataFrame) -> DataFrame:
    """Rows with all required fields and their share."""
    full = F.lit(True)
    for name in REQUIRED:
        full = full & F.col(name).isNotNull()
    return flights.agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.count_if(full).alias("complete_flights"),
        percent(F.count_if(full), F.count(F.lit(1))).alias("completeness_rate"),
    )


# Plausible ranges of positions.
RANGES = {
    "latitude": (-90, 90), "longitude": (-180, 180), "altitude": (0, 60000), "groundspeed": (0, 800), "heading": (0, 360),
}


def dq_position_ranges(flights: DataFrame) -> DataFrame:
    """Checked and valid values over all ranges, and the share of valid ones."""
    checked = sum((F.count(c) for c in RANGES), F.lit(0))
    valid = sum((F.count_if(F.col(c).between(*r)) for c, r in RANGES.items()), F.lit(0))
    return flights.agg(checked.alias("total_checks"), valid.alias("valid_positions")).withColumn(
        "accuracy_rate", percent(F.col("valid_positions"), F.col("total_checks"))
    )


def dq_critical_nulls(flights: DataFrame) -> DataFrame:
    """NULL or empty critical fields, one row per field."""
    counts = flights.agg(
        F.count_if(F.col("callsign").isNull() | (F.col("callsign") == "")).alias("callsign"),
        F.count_if(F.col("latitude").isNull()).alias("latitude"),
        F.count_if(F.col("longitude").isNull()).alias("longitude"),
    )
    return _unpivot(counts, "field", "missing")


def dq_business_rules(flights: DataFrame, controllers: DataFrame) -> DataFrame:
    """Violations per rule over flights and controllers."""
    f = flights.agg(
        F.count_if(F.coalesce(F.trim("callsign"), F.lit("")) == "").alias("blank_callsign"),
        F.count_if(F.col("altitude") < 0).alias("negative_altitude"),
    )
    c = controllers.agg(
        F.count_if(~F.col("rating").between(0, 15)).alias("invalid_rating"),
        F.count_if(F.col("cid") <= 0).alias("invalid_cid"),
    )
    return _unpivot(f, "rule", "violations").unionByName(_unpivot(c, "rule", "violations"))


def dq_session_duration(summaries: DataFrame) -> DataFrame:
    """Sessions whose stored minutes differ from the times by more than one."""
    secs = F.unix_seconds(F.col("session_end_time").cast("timestamp")) - F.unix_seconds(
        F.col("session_start_time").cast("timestamp")
    )
    off = F.abs(secs - F.col("session_duration_minutes") * 60)
    return summaries.where(off > 60).select(
        "id", "callsign", "session_start_time", "session_end_time",
        (secs / 60.0).alias("actual"), F.col("session_duration_minutes").alias("stored"), (off / 60.0).alias("difference"),
    )


def dq_summary_fields(summaries: DataFrame) -> DataFrame:
    """Sessions that miss an essential field, or whose peak exceeds the total."""
    issue = F.array_compact(F.array(
        F.when(F.coalesce("callsign", F.lit("")) == "", "Missing callsign"),
        F.when(F.col("session_start_time").isNull(), "Missing session start time"),
        F.when(F.col("session_duration_minutes").isNull(), "Missing session duration"),
        F.when(F.col("total_aircraft_handled").isNull(), "Missing aircraft count"),
        F.when(
            (F.col("total_aircraft_handled") != 0) & (F.col("peak_aircraft_count") > F.col("total_aircraft_handled")),
            "Peak count above total count",
        ),
    ))
    return summaries.select("id", F.explode(issue).alias("issue"))


def dq_sessions_per_callsign(controllers: DataFrame, least: int = 3) -> DataFrame:
    """Log-ons of callsigns with at least ``least`` of them, with the minutes
    since the one before. Rows are grouped to log-ons before the ordering."""
    made = "created_at" if "created_at" in controllers.columns else "last_updated"
    logons = controllers.groupBy("callsign", "logon_time").agg(
        F.min(made).alias("first_record"), F.max("last_updated").alias("last_record")
    )
    many = logons.groupBy("callsign").agg(F.count(F.lit(1)).alias("logon_count")).where(F.col("logon_count") >= least)
    timed = logons.withColumn("_s", F.unix_seconds(F.col("logon_time").cast("timestamp")))
    timed = neighbour(timed, "callsign", "logon_time", "_s", "_before", back=True)
    return timed.join(many, "callsign").select(
        "callsign", "logon_count", "logon_time", "first_record", "last_record",
        ((F.col("_s") - F.col("_before")) / 60.0).alias("gap_minutes"),
    )


# --- status ---------------------------------------------------------------------

# A table is stale after so many seconds; flights never are.
FRESH_SECONDS = {
    "controllers": 300, "flights": None, "transceivers": 300, "flight_summaries": 7200, "flight_sector_occupancy": 3600,
}


def freshness(tables: Mapping[str, tuple[DataFrame, str]], as_of) -> DataFrame:
    """Newest time, age and state per table: (frame, time column) by name."""
    out = None
    for name, (df, time) in tables.items():
        newest = df.agg(F.max(F.col(time)).alias("last_update"))
        age = (F.unix_seconds(at(as_of)) - F.unix_seconds(F.col("last_update").cast("timestamp"))).alias("age_seconds")
        row = newest.select(F.lit(name).alias("table_name"), "last_update", age)
        limit = FRESH_SECONDS[name]
        state = F.lit("fresh") if limit is None else F.when(F.col("age_seconds") < limit, "fresh").otherwise("stale")
        row = row.withColumn("status", F.when(F.col("last_update").isNotNull(), state))
        out = row if out is None else out.unionByName(row)
    return out


def stored_freshness(spark: SparkSession, store: str, as_of) -> DataFrame:
    """The same from the manifest of a store: no table is read."""
    newest = stored.statistics(spark, store).groupBy("table").agg(F.max("last").alias("last"))
    return freshness({name: (newest.where(F.col("table") == name), "last") for name in FRESH_SECONDS}, as_of)


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """Rows per required table from the manifest of a store; missing tables and columns as in ``table_counts``."""
    now = stored.latest(spark, store)
    counts = stored.statistics(spark, store).groupBy("table").agg(F.sum("rows").alias("n"))
    rows = []
    for name in REQUIRED_TABLES:
        present = name in now.schemas
        missing = [c for t, c in REQUIRED_COLUMNS if t == name and not (present and c in now.schemas[name].names)]
        rows.append((name, present, ",".join(missing)))
    needed = spark.createDataFrame(rows, "table_name string, present boolean, missing_columns string")
    n_rows = F.when(F.col("present"), F.coalesce("n", F.lit(0)))
    return needed.join(counts, F.col("table_name") == F.col("table"), "left").select(
        "table_name", n_rows.cast("long").alias("n_rows"), "present", "missing_columns")


def stored_activity(spark: SparkSession, store: str, names: Mapping[str, str], as_of) -> DataFrame:
    """``recent_activity`` of stored tables (time column by name).

    Totals and newest times come from the manifest; only folders whose newest
    row is of the last hour are read for the counts.
    """
    now = stored.latest(spark, store)
    hour = spark.range(1).select(F.unix_micros(ago(as_of, hours=1))).first()[0]
    out = None
    for name, time in names.items():
        entries = now.of(name)
        near = [e for e in entries if e.last is not None and e.last >= hour]
        recent = recent_activity({name: (stored.read(spark, store, name, now, near), time)}, as_of)
        newest = max((e.last for e in entries if e.last is not None), default=None)
        row = recent.withColumns({
            "total_rows": F.lit(sum(e.rows for e in entries)).cast("long"),
            "most_recent_update": F.timestamp_micros(F.lit(newest).cast("long"))})
        out = row if out is None else out.unionByName(row)
    return out


def overall_freshness(per_table: DataFrame) -> DataFrame:
    """One row: stale tables, missing live tables and the state of the whole."""
    live = F.col("table_name").isin("controllers", "flights", "transceivers")
    counts = per_table.agg(
        F.count_if(F.col("status") == "stale").alias("stale_tables"),
        F.count_if(live & F.col("last_update").isNull()).alias("critical_issues"),
    )
    state = F.when(F.col("critical_issues") > 0, "critical").when(F.col("stale_tables") > 0, "degraded").otherwise("operational")
    return counts.withColumn("status", state)


def recent_activity(tables: Mapping[str, tuple[DataFrame, str]], as_of) -> DataFrame:
    """Rows in all, of the last hour, ten minutes and minute, per table."""
    out = None
    for name, (df, time) in tables.items():
        def within(**parts) -> Column:
            return F.count_if(F.col(time) >= at(as_of) - F.make_interval(**{k: F.lit(v) for k, v in parts.items()}))

        row = df.agg(
            F.count(F.lit(1)).alias("total_rows"),
            within(hours=1).alias("last_hour"),
            within(mins=10).alias("last_10min"),
            within(mins=1).alias("last_minute"),
            F.max(F.col(time)).alias("most_recent_update"),
        ).select(F.lit(name).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def stay_activity(stays: DataFrame, as_of) -> DataFrame:
    """Open and closed stays, recent exits and their mean minutes."""
    hour = at(as_of) - F.make_interval(hours=F.lit(1))
    recent = F.col("exit_timestamp") >= hour
    secs = F.unix_seconds(F.col("exit_timestamp").cast("timestamp")) - F.unix_seconds(
        F.col("entry_timestamp").cast("timestamp")
    )
    return stays.agg(
        F.count(F.lit(1)).alias("total_sector_entries"),
        F.count_if(F.col("exit_timestamp").isNull()).alias("open_sectors"),
        F.count_if(F.col("exit_timestamp").isNotNull()).alias("closed_sectors"),
        F.count_if(F.col("entry_timestamp") >= hour).alias("sectors_last_hour"),
        F.count_if(recent).alias("recent_sector_exits"),
        (F.avg(F.when(recent, secs)) / 60.0).alias("avg_duration_minutes"),
    )


def recent_list(rows: DataFrame, time: str, as_of, columns: list[str], minutes: int = 10, n: int = 5) -> DataFrame:
    """The newest rows of the last minutes, with their age."""
    recent = rows.where(F.col(time) >= at(as_of) - F.make_interval(mins=F.lit(minutes)))
    age = (F.unix_seconds(at(as_of)) - F.unix_seconds(F.col(time).cast("timestamp"))) / 60.0
    top = recent.orderBy(F.desc(time), *columns).limit(n)
    return top.select(*columns, time, age.alias("minutes_ago"))


REQUIRED_TABLES = (
    "flights", "controllers", "transceivers", "flight_summaries", "flights_archive",
    "flight_sector_occupancy", "controller_summaries", "controllers_archive",
)
REQUIRED_COLUMNS = (("flights", "callsign"), ("controllers", "callsign"), ("flight_summaries", "deptime"), ("flights_archive", "deptime"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per required table; a missing table has NULL, and the needed
    columns that are missing are named."""
    out = None
    some = next(iter(tables.values()))
    for name in REQUIRED_TABLES:
        needed = [c for t, c in REQUIRED_COLUMNS if t == name]
        if name in tables:
            missing = [c for c in needed if c not in tables[name].columns]
            row = tables[name].agg(F.count(F.lit(1)).alias("n_rows"))
        else:
            missing = needed
            row = some.agg(F.lit(None).cast("bigint").alias("n_rows"))
        row = row.select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(name in tables).alias("present"),
            F.lit(",".join(missing)).alias("missing_columns"),
        )
        out = row if out is None else out.unionByName(row)
    return out
