"""Event-time streams: daily filter counts and live radio matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airtrace.functions.callsign import controller_type, proximity_nm
from airtrace.functions.exact import micros
from airtrace.functions.geo import nm_within
from airtrace.operators.bandjoin import Band, band_join
from airtrace.operators.contacts import FREQUENCY_HZ, TIME_SECONDS


def daily_filter_counts(rows: DataFrame, kept: Column, time: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Running counts per day; a day is final once the watermark has passed it."""
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(kept).alias("included"),
            F.count_if(~kept).alias("excluded"),
        )
        .select(F.to_date("w.start").alias("day"), "processed", "included", "excluded")
    )


def start_updates(counts: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store each changed row under its micro-batch; a repeated batch overwrites."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def newest_updates(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The latest stored row per key."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_n")).select(*keys, "_n.*")


def live_matches(flight_radios: DataFrame, atc_radios: DataFrame, secs: int = TIME_SECONDS, delay: str = "5 minutes") -> DataFrame:
    """Pairs of radio rows from two streams, by frequency, time and distance.

    It is the same bucketed equi-join as in batch. The watermarks and the time
    range let Spark drop a row from the state once no partner can come.
    """
    left = flight_radios.withWatermark("timestamp", delay).select(
        F.col("callsign").alias("flight_callsign"), "frequency", F.col("position_lat").alias("flight_lat"),
        F.col("position_lon").alias("flight_lon"), F.col("timestamp").alias("flight_time"),
        micros(F.col("timestamp")).alias("_us"),
    )
    right = atc_radios.withWatermark("timestamp", delay).select(
        F.col("callsign").alias("atc_callsign"), F.col("frequency").alias("atc_frequency"),
        F.col("position_lat").alias("atc_lat"), F.col("position_lon").alias("atc_lon"),
        F.col("timestamp").alias("atc_time"), micros(F.col("timestamp")).alias("_atc_us"),
        proximity_nm(controller_type(F.col("callsign"))).alias("limit_nm"),
    )
    span = F.make_dt_interval(secs=F.lit(secs))

    def close(l, r) -> Column:
        in_time = (l("flight_time") >= r("atc_time") - span) & (l("flight_time") <= r("atc_time") + span)
        return in_time & nm_within(l("flight_lat"), l("flight_lon"), r("atc_lat"), r("atc_lon"), r("limit_nm"))

    return band_join(
        left, right,
        [Band("frequency", "atc_frequency", FREQUENCY_HZ), Band("_us", "_atc_us", secs * 1_000_000)],
        condition=close,
    ).drop("_us", "_atc_us", "limit_nm")


def start_append(rows: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        rows.writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )
