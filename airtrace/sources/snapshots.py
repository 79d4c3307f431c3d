"""Landed network snapshots: reading, flattening, linking, appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airtrace import schemas
from airtrace.functions.values import parse_utc
from airtrace.operators.filters import join_atis
from airtrace.session import sortable_times


def src_snapshots(spark: SparkSession, path: str, schema: str = schemas.SNAPSHOT, multi_line: bool = False) -> DataFrame:
    """Snapshot documents of a landing folder.

    One document per line keeps files splittable; ``multi_line`` reads one
    document per file.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def stream_snapshots(spark: SparkSession, path: str, schema: str = schemas.SNAPSHOT, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def parse_controllers(snapshots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per controller; missing text becomes ''.

    ``keep`` names document columns to carry along, such as the poll time.
    """
    rows = snapshots.select(*keep, F.explode("controllers").alias("c"))
    return rows.select(
        *keep,
        _text("c.callsign").alias("callsign"),
        _text("c.frequency").alias("frequency"),
        F.col("c.cid").alias("cid"),
        _text("c.name").alias("name"),
        F.col("c.rating").alias("rating"),
        F.col("c.facility").alias("facility"),
        F.col("c.visual_range").alias("visual_range"),
        join_atis(F.col("c.text_atis")).alias("text_atis"),
        _text("c.server").alias("server"),
        parse_utc(F.col("c.last_updated")).alias("last_updated"),
        parse_utc(F.col("c.logon_time")).alias("logon_time"),
    )


# Stored flight columns taken from the plan and from the pilot as they are.
PLAN_FIELDS = ("flight_rules", "aircraft_faa", "aircraft_short", "alternate", "cruise_tas")
PLAN_TIMES = ("deptime", "enroute_time", "fuel_time", "remarks")
PILOT_FIELDS = ("cid", "name", "server", "pilot_rating", "military_rating", "transponder")


def parse_flights(snapshots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per pilot with the flight plan flattened; no plan gives ''."""
    rows = snapshots.select(*keep, F.explode("pilots").alias("p"))
    plan = "p.flight_plan."
    return rows.select(
        *keep,
        _text("p.callsign").alias("callsign"),
        _text(plan + "aircraft_short").alias("aircraft_type"),
        F.col("p.latitude").alias("latitude"),
        F.col("p.longitude").alias("longitude"),
        F.coalesce(F.col("p.altitude"), F.lit(0)).alias("altitude"),
        F.col("p.heading").alias("heading"),
        F.col("p.groundspeed").alias("groundspeed"),
        _text(plan + "departure").alias("departure"),
        _text(plan + "arrival").alias("arrival"),
        _text(plan + "route").alias("route"),
        *[F.col(plan + name).alias(name) for name in PLAN_FIELDS],
        F.col(plan + "altitude").alias("planned_altitude"),
        *[F.col(plan + name).alias(name) for name in PLAN_TIMES],
        parse_utc(F.col("p.last_updated")).alias("last_updated"),
        *[F.col("p." + name).alias(name) for name in PILOT_FIELDS],
        parse_utc(F.col("p.logon_time")).alias("logon_time"),
    )


def parse_transceivers(snapshots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per radio of each callsign of the ``transceivers`` array."""
    entries = snapshots.select(*keep, F.explode("transceivers").alias("e"))
    rows = entries.select(*keep, _text("e.callsign").alias("callsign"), F.explode("e.transceivers").alias("t"))
    return rows.select(
        *keep,
        "callsign",
        F.coalesce(F.col("t.id"), F.lit(0)).alias("transceiver_id"),
        F.coalesce(F.col("t.frequency"), F.lit(0)).cast("long").alias("frequency"),
        F.col("t.latDeg").alias("position_lat"),
        F.col("t.lonDeg").alias("position_lon"),
        F.col("t.heightMslM").alias("height_msl"),
        F.col("t.heightAglM").alias("height_agl"),
        F.lit("flight").alias("entity_type"),
        parse_utc(F.col("t.timestamp")).alias("timestamp"),
    )


def link_transceivers(
    radios: DataFrame, flights: DataFrame, controllers: DataFrame, keys: tuple[str, ...] = ("callsign",)
) -> DataFrame:
    """entity_type by callsign: a pilot first, then a controller, else flight.

    ``keys`` may add the poll, so that a callsign is looked up in its own poll.
    One lookup holds both kinds, so the radio rows are shuffled once at most.
    """
    roles = (
        flights.select(*keys, F.lit(0).alias("rank"))
        .unionByName(controllers.select(*keys, F.lit(1).alias("rank")))
        .groupBy(*keys)
        .agg(F.min("rank").alias("_rank"))
    )
    return (
        radios.join(roles, list(keys), "left")
        .withColumn("entity_type", F.when(F.col("_rank") == 1, "atc").otherwise("flight"))
        .drop("_rank")
    )


def sink_append(df: DataFrame, path: str, time: str, extra_partitions: tuple[str, ...] = ()) -> None:
    """Append to a table partitioned by date.

    Rows are brought together by date and rebalanced: Spark cuts a busy date
    into as many write tasks as its size asks for and joins small ones.
    """
    columns = ["date", *extra_partitions]
    out = df.withColumn("date", F.to_date(time))
    with sortable_times(df.sparkSession):
        out.hint("rebalance", *columns).write.mode("append").partitionBy(*columns).parquet(path)


def sink_csv_report(df: DataFrame, path: str) -> None:
    """Write a report with a header. A report is small; big ones keep their parts."""
    df.write.mode("overwrite").option("header", True).csv(path)
