"""Row filters of the ingest pipeline and their counts."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.functions.geo import point_in_edges, point_in_polygon
from airtrace.functions.values import khz, nonblank

Ring = Sequence[tuple[float, float]]

# The aviation band in MHz, the largest frequency taken as valid,
# and the callsign pattern dropped by default.
BAND_MHZ = (118, 137)
MAX_HZ = 999_999_999_999
CALLSIGN_PATTERNS = ("ATIS",)


def _within(rows: DataFrame, lat: str, lon: str, boundary: Ring | DataFrame) -> DataFrame:
    """Rows strictly inside a ring, or without a position.

    A boundary frame (ord, lat1, lon1, lat2, lon2) is one polygon, so its few
    edges enter the plan as a scalar sub-query.
    """
    a, b = F.col(lat), F.col(lon)
    unknown = a.isNull() | b.isNull()
    if not isinstance(boundary, DataFrame):
        return rows.where(unknown | point_in_polygon(a, b, boundary))
    edges = boundary.agg(F.collect_list(F.struct("lat1", "lon1", "lat2", "lon2"))).scalar()
    tagged = rows.withColumn("_edges", edges)
    return tagged.where(unknown | point_in_edges(a, b, F.col("_edges"))).drop("_edges")


def filter_boundary_flights(flights: DataFrame, boundary: Ring | DataFrame) -> DataFrame:
    """Keep flights inside the ring; a flight without a position is kept."""
    return _within(flights, "latitude", "longitude", boundary)


def filter_boundary_transceivers(transceivers: DataFrame, boundary: Ring | DataFrame) -> DataFrame:
    return _within(transceivers, "position_lat", "position_lon", boundary)


def filter_boundary_snapshot(snapshots: DataFrame, ring: Ring) -> DataFrame:
    """Apply the flight filter to the ``pilots`` array before it is flattened."""
    def keep(p: Column) -> Column:
        lat, lon = p["latitude"], p["longitude"]
        return lat.isNull() | lon.isNull() | point_in_polygon(lat, lon, ring)

    return snapshots.withColumn("pilots", F.filter("pilots", keep))


def filter_controller_allowlist(controllers: DataFrame, allow: DataFrame) -> DataFrame:
    """Keep callsigns on the list; blank ones go. An empty list keeps all.

    Whether the list is empty is a scalar sub-query of the plan.
    """
    listed = allow.select(F.col("callsign").alias("_allowed")).distinct()
    size = listed.agg(F.count(F.lit(1))).scalar()
    tagged = controllers.join(listed, F.col("callsign") == F.col("_allowed"), "left")
    on_list = nonblank(F.col("callsign")) & F.col("_allowed").isNotNull()
    return tagged.where((size == 0) | on_list).drop("_allowed")


def filter_callsign_pattern(rows: DataFrame, patterns: Sequence[str] = CALLSIGN_PATTERNS) -> DataFrame:
    """Drop callsigns that contain one of the texts; a blank callsign stays."""
    hit = F.lit(False)
    for text in patterns:
        hit = hit | F.col("callsign").contains(text)
    return rows.where(~F.coalesce(hit, F.lit(False)))


def frequency_kept(hz: Column, excluded_mhz: Sequence[float | str]) -> Column:
    """False for an excluded or impossible frequency."""
    low, high = BAND_MHZ
    listed = [int(Decimal(str(m)) * 1000) for m in excluded_mhz if low <= Decimal(str(m)) <= high]
    if not listed:
        return F.lit(True)
    possible = hz.between(0, MAX_HZ)
    return F.coalesce((hz == 0) | (possible & ~khz(hz).isin(listed)), F.lit(True))


def filter_frequency(radios: DataFrame, excluded_mhz: Sequence[float | str]) -> DataFrame:
    """Drop radio rows on the excluded frequencies (compared in whole kHz)."""
    return radios.where(frequency_kept(F.col("frequency"), excluded_mhz))


def filter_incomplete_plan(flights: DataFrame) -> DataFrame:
    """Drop flights without a departure or an arrival."""
    return flights.where(nonblank(F.col("departure")) & nonblank(F.col("arrival")))


def filter_counts(rows: DataFrame, kept: Column, unknown: Column | None = None) -> DataFrame:
    """Processed, included, excluded and without-position counts in one pass."""
    unknown = F.lit(False) if unknown is None else unknown
    return rows.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(kept).alias("included"),
        F.count_if(~kept).alias("excluded"),
        F.count_if(unknown).alias("no_position"),
    )


def filter_daily_stats(rows: DataFrame, kept: Column, time: str, as_of: Column, days: int = 7) -> DataFrame:
    """Processed, included and excluded rows per day of the last ``days``."""
    day = F.to_date(F.col(time))
    return (
        rows.groupBy(day.alias("day"))
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(kept).alias("included"),
            F.count_if(~kept).alias("excluded"),
        )
        .where(F.col("day") >= F.date_sub(F.to_date(as_of), days))
    )


def cleanup_invalid_controllers(controllers: DataFrame, allow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows to remove): not listed or with a blank callsign."""
    listed = allow.select("callsign").distinct()
    named = controllers.where(F.trim("callsign") != "")
    stay = named.join(listed, "callsign", "left_semi")
    gone = controllers.join(listed.where(F.trim("callsign") != ""), "callsign", "left_anti")
    return stay, gone


def cleanup_report(controllers: DataFrame, allow: DataFrame) -> DataFrame:
    """Dry run: how many rows and callsigns would stay and go."""
    stay, gone = cleanup_invalid_controllers(controllers, allow)

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("action"),
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct("callsign").alias("n_callsigns"),
        )

    return counts(stay, "keep").unionByName(counts(gone, "remove"))


def mask_names(controllers: DataFrame, as_of: Column) -> DataFrame:
    return controllers.withColumns({"name": F.lit("x"), "updated_at": as_of})


def join_atis(lines: Column) -> Column:
    """ATIS lines to one text; a missing list stays missing."""
    return F.when(lines.isNotNull(), F.concat_ws(" ", lines))
