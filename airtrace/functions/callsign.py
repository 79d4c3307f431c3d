"""Rules that read a controller callsign."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Controller type by the last three letters of the callsign.
TYPE_BY_SUFFIX = {
    "GND": "Ground",
    "DEL": "Ground",
    "TWR": "Tower",
    "APP": "Approach",
    "DEP": "Approach",
    "CTR": "Center",
    "FSS": "FSS",
}
DEFAULT_TYPE = "Ground"

# Radio range by controller type in nautical miles.
RANGE_NM = {"Ground": 15, "Tower": 15, "Approach": 60, "Center": 400, "FSS": 1000}
DEFAULT_RANGE_NM = 30

# Search orders of the three text rules; the first hit wins.
CONTACT_ORDER = ("CTR", "TMA", "TWR", "GND", "DEL", "FSS")
POSITION_ORDER = ("FSS", "CTR", "APP", "TWR", "GND", "DEL")
SESSION_ORDER = ("GND", "TWR", "APP", "CTR", "FSS", "DEL")

# Names of the controller ratings in the rank report.
RANK_NAMES = {
    1: "Observer",
    2: "Student",
    3: "Student 2",
    4: "Student 3",
    5: "Controller",
    6: "Controller 2",
    7: "Instructor",
    8: "Instructor 2",
    9: "Supervisor",
    10: "Administrator",
}


def lookup(key: Column, table: Mapping, default) -> Column:
    """A CASE over a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def first_contained(text: Column, order: Sequence[str], default: str = "OTHER") -> Column:
    out = None
    for word in order:
        hit = text.contains(word)
        out = F.when(hit, F.lit(word)) if out is None else out.when(hit, F.lit(word))
    return out.otherwise(F.lit(default))


def controller_type(callsign: Column) -> Column:
    return lookup(F.upper(F.right(callsign, F.lit(3))), TYPE_BY_SUFFIX, DEFAULT_TYPE)


def proximity_nm(kind: Column, limits: Mapping[str, int] | None = None) -> Column:
    return lookup(kind, limits or RANGE_NM, DEFAULT_RANGE_NM)


def contact_type(callsign: Column) -> Column:
    return first_contained(F.upper(callsign), CONTACT_ORDER)


def position_type(callsign: Column, order: Sequence[str] = POSITION_ORDER) -> Column:
    return first_contained(callsign, order)


def rank_name(rating: Column) -> Column:
    return lookup(rating, RANK_NAMES, "Unknown")


def controller_info(controllers: DataFrame) -> DataFrame:
    """Type, range, threshold and method for each controller callsign."""
    kind = controller_type(F.col("callsign"))
    return controllers.select("callsign").distinct().select(
        "callsign",
        kind.alias("type"),
        proximity_nm(kind).alias("proximity_range"),
        proximity_nm(kind).alias("proximity_threshold"),
        F.lit("last_three_chars").alias("detection_method"),
    )
