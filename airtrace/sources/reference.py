"""Static reference data: polygons, sectors, hierarchies, callsign lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from airtrace.functions.geo import EDGE_TYPE

_RING = "array<array<double>>"


def edges_of(points: Column) -> Column:
    """Array of edges from an array of (lat, lon) structs, closed if open."""
    closed = F.when(points[0] == F.element_at(points, -1), points).otherwise(
        F.concat(points, F.slice(points, 1, 1))
    )
    starts = F.slice(closed, F.lit(1), F.size(closed) - 1)
    ends = F.slice(closed, F.lit(2), F.size(closed) - 1)
    edge = F.zip_with(
        starts, ends,
        lambda a, b: F.struct(
            a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2")
        ),
    )
    return edge.cast(f"array<{EDGE_TYPE}>")


def src_polygon(spark: SparkSession, path: str) -> DataFrame:
    """Edges (ord, lat1, lon1, lat2, lon2) of the boundary in a JSON document.

    A ``Polygon`` holds rings of [lon, lat]; any other document with
    ``coordinates`` holds one plain list of [lat, lon].
    """
    doc = F.from_json("value", "type string, coordinates string")
    geo = F.from_json(doc["coordinates"], f"array<{_RING}>")[0]
    plain = F.from_json(doc["coordinates"], _RING)
    points = F.when(
        doc["type"] == "Polygon",
        F.transform(geo, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))),
    ).otherwise(F.transform(plain, lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon"))))
    ring = spark.read.text(path, wholetext=True).select(points.alias("points")).where(F.size("points") >= 3)
    return ring.select(F.posexplode(edges_of(F.col("points"))).alias("ord", "e")).select("ord", "e.*")


# Metadata fields of a sector and the text for a missing one.
SECTOR_FIELDS = ("sector_type", "callsign", "frequency", "full_name", "volumes", "responsible_sectors")
NO_VALUE = "N/A"


def src_sectors(spark: SparkSession, path: str) -> DataFrame:
    """Sectors of GeoJSON FeatureCollections, in file order.

    Only ``Polygon`` features with a name and three or more points in the first
    ring are kept. Each file is one document; a folder may hold many, and then
    ``ord`` follows the file name and the place in the file. The list is
    reference data, so one window over it is small.
    """
    features = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    doc = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", features)["features"].alias("f"))
    rows = doc.select("file", F.posexplode("f").alias("place", "s"))
    rows = rows.withColumn("ord", F.row_number().over(Window.orderBy("file", "place")) - 1)
    ring = F.from_json(F.col("s.geometry.coordinates"), f"array<{_RING}>")[0]
    points = F.transform(ring, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))

    def prop(name: str) -> Column:
        return F.try_element_at("s.properties", F.lit(name))

    return (
        rows.where((F.col("s.geometry.type") == "Polygon") & (prop("name") != ""))
        .select(
            "ord",
            prop("name").alias("sector_name"),
            *[F.coalesce(prop(n), F.lit(NO_VALUE)).alias(n) for n in SECTOR_FIELDS],
            points.alias("points"),
        )
        .where(F.size("points") >= 3)
        .withColumn("edges", edges_of(F.col("points")))
        .drop("points")
    )


def rectangle_sectors(rectangles: DataFrame) -> DataFrame:
    """Sectors from (ord, sector_name, lat/lon bounds) rows."""
    def corner(lat: str, lon: str) -> Column:
        return F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))

    points = F.array(
        corner("lat_min", "lon_min"), corner("lat_max", "lon_min"),
        corner("lat_max", "lon_max"), corner("lat_min", "lon_max"),
    )
    kept = [c for c in rectangles.columns if c not in ("lat_min", "lat_max", "lon_min", "lon_max")]
    return rectangles.select(*kept, edges_of(points).alias("edges"))


def src_sector_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """``MAIN:SUB,SUB`` lines to (main_sector, sector_name) rows."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line.contains(":") & ~line.startswith("#"))
    parts = F.split(line, ":", 2)
    return rows.select(
        F.trim(parts[0]).alias("main_sector"), F.explode(F.split(parts[1], ",")).alias("sub")
    ).select("main_sector", F.trim("sub").alias("sector_name")).where("sector_name <> ''")


def src_valid_callsigns(spark: SparkSession, path: str) -> DataFrame:
    """Callsigns of a text file, without blank and ``#`` lines."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("callsign"))


def src_aircraft_types(spark: SparkSession, path: str) -> list[str]:
    """Type codes of a text file (one a line, ``#`` for remarks), such as the
    military types that ``military_routes`` takes. A short list, so it comes back
    as one."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("t")).distinct()
    return sorted(r.t for r in rows.collect())


def src_airport_states(spark: SparkSession, path: str) -> DataFrame:
    """Airport list (icao_code, state, municipality) of a CSV with a header.

    Repeated codes stay: a join to the list then gives one row per entry.
    """
    return spark.read.schema("icao_code string, state string, municipality string").option("header", True).csv(path)


def union_literals(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows as a frame (the UNION ALL of one-row selects)."""
    return spark.createDataFrame(list(rows), schema)
