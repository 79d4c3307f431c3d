"""Cells on the globe, so that closeness in miles becomes an equality of cells.

A place lies in one cell of a grid of ten degrees; a station lists the cells its
circle can touch. The two share exactly one cell if they are within reach, so a
join on cells gives each pair once at most, and the exact distance decides. Only
the stations, which are few, are copied: to one or two cells for a tower, to
some twenty for the largest usual range, and to the 684 of the globe at most.

Circles that hold a pole take all longitudes, and longitudes run on across the
date line. Unknown positions have no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.functions.geo import EARTH_RADIUS_NM

DEGREES = 10
AROUND = 360 // DEGREES
NM_PER_DEGREE = EARTH_RADIUS_NM * 3.141592653589793 / 180
#: Degrees by which a circle is taken larger, against rounding.
SLACK = 1e-4


def _on_globe(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same place with a latitude within 90 degrees and a longitude counted from 180 W, up to 360."""
    over = F.abs(lat) > 90
    back = over & (F.cos(F.radians(lat)) < 0)
    return (
        F.when(over, F.degrees(F.asin(F.sin(F.radians(lat))))).otherwise(lat),
        F.pmod(F.when(back, lon + 180).otherwise(lon) + 180, F.lit(360.0)),
    )


def place_cell(lat: Column, lon: Column) -> Column:
    """The cell of a place, null where it is unknown."""
    north, east = _on_globe(lat, lon)
    column = F.least(F.floor(east / DEGREES), F.lit(AROUND - 1))
    return (F.floor((north + 90) / DEGREES) * AROUND + column).cast("long")


def with_reach_cells(df: DataFrame, lat: str, lon: str, limit: str, name: str) -> DataFrame:
    """A row for each cell that the circle of ``limit`` miles around a row's place can touch."""
    north, east = _on_globe(F.col(lat), F.col(lon))
    reach = F.col(limit) / NM_PER_DEGREE + SLACK
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(limit) >= 0)
    rows = F.sequence(
        F.floor((F.greatest(north - reach, F.lit(-90.0)) + 90) / DEGREES),
        F.floor((F.least(north + reach, F.lit(90.0)) + 90) / DEGREES))
    # how far a circle that holds no pole reaches east and west
    wide = F.degrees(F.asin(F.sin(F.radians(reach)) / F.cos(F.radians(north)))) + SLACK
    columns = F.when(
        F.abs(north) + reach >= 90 - SLACK, F.sequence(F.lit(0).cast("long"), F.lit(AROUND - 1).cast("long"))
    ).otherwise(F.sequence(F.floor((east - wide) / DEGREES), F.floor((east + wide) / DEGREES)))
    out = df.where(known).withColumn("_row", F.explode(rows)).withColumn("_column", F.explode(columns))
    cell = F.col("_row") * AROUND + F.pmod("_column", F.lit(AROUND).cast("long"))
    return out.withColumn(name, cell.cast("long")).drop("_row", "_column")
