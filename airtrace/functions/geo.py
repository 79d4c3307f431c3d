"""Distance and containment as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: earth radius in nautical miles.
EARTH_RADIUS_NM = 3440.065

EDGE_TYPE = "struct<lat1:double,lon1:double,lat2:double,lon2:double>"


def nm_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles by the cosine rule."""
    cosine = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(F.radians(lon1 - lon2))
    return F.lit(EARTH_RADIUS_NM) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def nm_within(lat1: Column, lon1: Column, lat2: Column, lon2: Column, limit: Column | float) -> Column:
    """True where both positions are known and at most ``limit`` miles apart."""
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return known & (nm_distance(lat1, lon1, lat2, lon2) <= limit)


def deg_within(lat1: Column, lon1: Column, lat2: Column, lon2: Column, limit: float) -> Column:
    """Plane distance in degrees, NULL (no match) where a position is missing."""
    return F.sqrt(F.pow(lat1 - lat2, F.lit(2)) + F.pow(lon1 - lon2, F.lit(2))) <= F.lit(limit)


def _edge_step(acc: Column, lat: Column, lon: Column, e: Column) -> Column:
    """Fold one edge into ``acc``: -1 once the point lies on the ring, else the
    parity of the edges cut by the ray toward larger longitudes."""
    a, b = e["lat1"] - lat, e["lat2"] - lat
    # > 0 on one side of the edge, 0 on its line
    side = (e["lon1"] - lon) * (b - a) - (e["lon2"] - e["lon1"]) * a
    on_edge = (side == 0) & lon.between(F.least(e["lon1"], e["lon2"]), F.greatest(e["lon1"], e["lon2"]))
    cut = F.when((a > 0) != (b > 0), (side > 0) == (b > a)).otherwise(False)
    return (
        F.when(a * b > 0, acc)  # the whole edge is north or south of the point
        .when((acc < 0) | on_edge, F.lit(-1))
        .when(cut, 1 - acc)
        .otherwise(acc)
    )


def _valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def point_in_edges(lat: Column, lon: Column, edges: Column) -> Column:
    """Strict containment in a ring held as an array of edges.

    A point on the ring is outside, as is one with an impossible position. Only
    the edges at the latitude of the point matter; the array may lack others.
    """
    cuts = F.aggregate(edges, F.lit(0), lambda acc, e: _edge_step(acc, lat, lon, e))
    return _valid(lat, lon) & F.coalesce(cuts == 1, F.lit(False))


Edge = tuple[float, float, float, float]


def ring_edges(ring: Sequence[tuple[float, float]]) -> list[Edge]:
    """(lat1, lon1, lat2, lon2) of a ring of (lat, lon) points, closed if open."""
    points = [(float(a), float(b)) for a, b in ring]
    if len(set(points)) < 3:
        raise ValueError("a polygon needs three points")
    if points[0] != points[-1]:
        points.append(points[0])
    return [(*a, *b) for a, b in zip(points, points[1:])]


def _as_json(edges: Sequence[Edge]) -> list[dict]:
    return [dict(zip(("lat1", "lon1", "lat2", "lon2"), e)) for e in edges]


def edges_literal(ring: Sequence[tuple[float, float]]) -> Column:
    """The ring as one array literal (the constant text is parsed once)."""
    return F.from_json(F.lit(json.dumps(_as_json(ring_edges(ring)))), f"array<{EDGE_TYPE}>")


def point_in_polygon(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Strict containment in a fixed ring of (lat, lon) points.

    The box comes first. Inside it the latitude picks one of many thin bands,
    and only the few edges that reach into the band are tested, so the cost
    does not grow with the number of points.
    """
    edges = ring_edges(ring)
    lats = [e[0] for e in edges]
    lons = [e[1] for e in edges]
    low, high = min(lats), max(lats)
    count = min(4 * len(edges), 512)
    height = (high - low) / count
    slack = height * 1e-6  # a latitude on a border may fall in either band
    bands = [
        _as_json([
            e for e in edges
            if min(e[0], e[2]) <= low + (k + 1) * height + slack and max(e[0], e[2]) >= low + k * height - slack
        ])
        for k in range(count)
    ]
    table = F.from_json(F.lit(json.dumps(bands)), f"array<array<{EDGE_TYPE}>>")
    box = (lat > low) & (lat < high) & (lon > min(lons)) & (lon < max(lons))
    band = F.least(F.floor((lat - low) / height), F.lit(count - 1)).cast("int")
    return F.coalesce(box & point_in_edges(lat, lon, F.get(table, band)), F.lit(False))


# Fixed patterns: an optional sign, then DDMMSS.s, DDDMMSS.s or decimal degrees.
DECIMAL_DEGREES = r"^([+-]?)(\d{0,3}\.\d*)$"
DEGREES_MINUTES_SECONDS = r"^([+-]?)(\d{2,3})(\d{2})(\d{2}\.\d*)$"


def parse_coordinate(text: Column) -> Column:
    """Coordinate text to decimal degrees, NULL where it has no known form."""
    value = F.trim(text)
    sign = F.when(value.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(value, pattern, group).try_cast("double")

    dms = DEGREES_MINUTES_SECONDS
    return F.when(value.rlike(DECIMAL_DEGREES), sign * part(DECIMAL_DEGREES, 2)).when(
        value.rlike(dms), sign * (part(dms, 2) + part(dms, 3) / 60.0 + part(dms, 4) / 3600.0)
    )
