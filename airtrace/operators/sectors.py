"""Airspace sectors: which sector holds a point, and how long aircraft stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from airtrace.functions.geo import point_in_edges
from airtrace.session import broadcast_if_few

# An aircraft is in a sector from 60 kt on, and a gap of more
# than 300 s ends its stay.
ENTRY_KNOTS = 60
GAP_SECONDS = 300


def sector_cells(sectors: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """One row per one-degree cell with the sectors that may reach into it.

    There are at most 360 x 180 cells, whatever the number of points. Of each
    sector only the edges at the latitudes of the cell are kept.
    """
    lats = F.transform("edges", lambda e: e["lat1"])
    lons = F.transform("edges", lambda e: e["lon1"])

    def span(values: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.array_min(values)), F.floor(F.array_max(values))))

    columns = ["ord", "sector_name"]
    if hierarchy is not None:
        sectors = sectors.join(hierarchy.select("sector_name", F.col("main_sector").alias("main")), "sector_name")
        columns.append("main")
    def reaches(e: Column) -> Column:
        south, north = F.least(e["lat1"], e["lat2"]), F.greatest(e["lat1"], e["lat2"])
        return (south <= F.col("_cell_lat") + 1) & (north >= F.col("_cell_lat"))

    boxed = sectors.withColumn("_cell_lat", span(lats)).withColumn("_cell_lon", span(lons))
    boxed = boxed.withColumn("edges", F.filter("edges", reaches))
    return boxed.groupBy("_cell_lat", "_cell_lon").agg(
        F.sort_array(F.collect_list(F.struct(*columns, "edges"))).alias("_sectors")
    )


def _at_cell(points: DataFrame, cells: DataFrame, lat: str, lon: str) -> DataFrame:
    # 360 x 180 cells at most, so the rows of cells always pass the count
    keyed = points.withColumns({"_cell_lat": F.floor(lat), "_cell_lon": F.floor(lon)})
    return keyed.join(broadcast_if_few(cells), ["_cell_lat", "_cell_lon"], "left").drop("_cell_lat", "_cell_lon")


def sector_for_point(points: DataFrame, sectors: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add ``sector_name``: the first sector in file order around the point.

    A point meets one row of sectors (its cell), so nothing fans out and no
    aggregation is needed afterwards.
    """
    hit = F.filter("_sectors", lambda s: point_in_edges(F.col(lat), F.col(lon), s["edges"]))
    return (
        _at_cell(points, sector_cells(sectors), lat, lon)
        .withColumn("sector_name", F.get(hit, F.lit(0))["sector_name"])
        .drop("_sectors")
    )


def main_sector_for_point(
    points: DataFrame, sectors: DataFrame, hierarchy: DataFrame, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Add ``main_sector``: one row per main sector that holds the point.

    A main sector is the union of its members. A point outside all keeps one
    row with NULL.
    """
    hits = F.filter("_sectors", lambda s: point_in_edges(F.col(lat), F.col(lon), s["edges"]))
    names = F.array_distinct(F.transform(hits, lambda s: s["main"]))
    return (
        _at_cell(points, sector_cells(sectors, hierarchy), lat, lon)
        .withColumn("main_sector", F.explode_outer(names))
        .drop("_sectors")
    )


def sector_stays(
    flights: DataFrame, sectors: DataFrame, chunk_hours: int = 6, as_of: Column | None = None
) -> DataFrame:
    """Stays of each aircraft in sectors, from its stored positions.

    Rules, per callsign in time order: from 60 kt on the aircraft is in the
    sector around its position, below it is in none; a row without speed or
    position keeps the former state. A change of sector ends the stay at the
    row before the change, and a gap of more than 300 s ends it at the row
    before the gap and forgets the state. The stay that holds the last row of
    an aircraft stays open, unless ``as_of`` is more than 300 s later.

    Two shuffles, and no task depends on the rows of a whole aircraft:

    1. Rows are shuffled by (callsign, time chunk), so a callsign with a third
       of all rows is spread over its chunks. Windows over that one order
       reduce each chunk to pieces of equal state.
    2. Only the first two and the last piece of a chunk can depend on, or reach
       into, another chunk. These meet per callsign, at most three per chunk;
       the others are whole stays and are spread by a hash.
    """
    placed = sector_for_point(flights, sectors).select(
        "callsign", "id", F.col("last_updated").alias("t"), "latitude", "longitude", "altitude",
        F.when(F.col("groundspeed").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull(), None)
        .when(F.col("groundspeed") >= ENTRY_KNOTS, F.coalesce("sector_name", F.lit("")))
        .otherwise("")
        .alias("seen"),
    )
    secs = F.unix_seconds(F.col("t").cast("timestamp"))
    rows = placed.select(
        "callsign", F.floor(secs / (chunk_hours * 3600)).alias("chunk"), "seen",
        F.struct(secs.alias("s"), "id", "t", "latitude", "longitude", "altitude").alias("at"),
    )

    # 1. pieces of equal state inside a chunk; NULL is "as before the chunk"
    w = W.partitionBy("callsign", "chunk").orderBy("at.s", "at.id")
    rows = rows.withColumn("gap", F.col("at.s") - F.lag("at.s").over(w) > GAP_SECONDS)
    known = F.coalesce("seen", F.when(F.col("gap"), ""))
    rows = rows.withColumn("state", F.last(known, ignorenulls=True).over(w))
    starts = F.col("gap").isNull() | F.col("gap") | ~F.col("state").eqNullSafe(F.lag("state").over(w))
    rows = rows.withColumn("starts", starts)
    rows = rows.withColumn("ends", F.coalesce(F.lead("starts").over(w), F.lit(True)))
    rows = rows.where("starts or ends")
    rows = rows.withColumn("until", F.when(F.col("ends"), F.col("at")).otherwise(F.lead("at").over(w)))
    pieces = rows.where("starts").withColumns(
        {"n": F.row_number().over(w), "last": F.lead(F.lit(1)).over(w).isNull()}
    )

    # 2. pieces at the chunk borders meet per callsign
    border = (F.col("n") <= 2) | F.col("last")
    lane = F.when(border, F.lit(-1)).otherwise(F.pmod(F.xxhash64("chunk", "n"), F.lit(1 << 30)))
    pieces = pieces.select("callsign", lane.alias("lane"), "chunk", "n", "gap", "state", "at", "until")
    p = W.partitionBy("callsign", "lane").orderBy("chunk", "n")
    border_gap = F.coalesce(F.col("at.s") - F.lag("until.s").over(p) > GAP_SECONDS, F.lit(True))
    pieces = pieces.withColumn("gap", F.when(F.col("n") == 1, border_gap).otherwise(F.col("gap")))
    known = F.coalesce("state", F.when(F.col("gap"), ""))
    pieces = pieces.withColumn("state", F.last(known, ignorenulls=True).over(p))
    # from the third piece on, a piece differs from its neighbour by construction
    new = (F.col("n") > 2) | F.col("gap") | (F.col("state") != F.lag("state").over(p))
    pieces = pieces.withColumns({"new": new, "newest": F.lead(F.lit(1)).over(p).isNull() & (F.col("lane") == -1)})
    chained = pieces.withColumn("chain", F.sum(F.col("new").cast("int")).over(p))
    merged = chained.where("state <> ''").groupBy("callsign", "lane", "chain").agg(
        F.first("state").alias("state"), F.min("at").alias("a"), F.max("until").alias("b"), F.max("newest").alias("_open")
    )

    open_ = F.col("_open")
    if as_of is not None:
        open_ = open_ & (F.unix_seconds(as_of) - F.col("b.s") <= GAP_SECONDS)
    closed = ~open_
    return merged.select(
        "callsign",
        F.col("state").alias("sector_name"),
        F.col("a.t").alias("entry_timestamp"),
        F.when(closed, F.col("b.t")).alias("exit_timestamp"),
        F.when(closed, F.col("b.s") - F.col("a.s")).otherwise(0).cast("int").alias("duration_seconds"),
        F.col("a.latitude").alias("entry_lat"),
        F.col("a.longitude").alias("entry_lon"),
        F.when(closed, F.col("b.latitude")).alias("exit_lat"),
        F.when(closed, F.col("b.longitude")).alias("exit_lon"),
        F.col("a.altitude").alias("entry_altitude"),
        F.when(closed, F.col("b.altitude")).alias("exit_altitude"),
    )


def newest_rows(flights: DataFrame) -> DataFrame:
    """Newest stored row per callsign; partial maxima make it safe on hot keys."""
    place = F.struct("latitude", "longitude", "altitude", "last_updated", "id")
    return (
        flights.groupBy("callsign")
        .agg(F.max_by(place, F.struct("last_updated", "id")).alias("n"))
        .select(
            "callsign",
            F.col("n.latitude").alias("new_lat"),
            F.col("n.longitude").alias("new_lon"),
            F.col("n.altitude").alias("new_altitude"),
            F.col("n.last_updated").alias("newest"),
        )
    )


def _stale(as_of: Column, secs: int) -> Column:
    return as_of - F.make_interval(secs=F.lit(secs))


def stale_sectors(stays: DataFrame, flights: DataFrame, as_of: Column, secs: int = GAP_SECONDS) -> DataFrame:
    """Open stays of aircraft whose newest row is older than ``secs``."""
    open_stays = stays.where(F.col("exit_timestamp").isNull())
    return open_stays.join(newest_rows(flights), "callsign").where(F.col("newest") < _stale(as_of, secs)).select(
        "callsign", "sector_name", "entry_timestamp", "new_lat", "new_lon", "new_altitude", "newest"
    ).distinct()


def stale_sector_count(stays: DataFrame, flights: DataFrame, as_of: Column, secs: int = GAP_SECONDS) -> DataFrame:
    """Open stays times all their old flight rows, as one count.

    Both sides are counted per callsign and the counts multiplied.
    """
    open_stays = stays.where(F.col("exit_timestamp").isNull()).groupBy("callsign").agg(F.count(F.lit(1)).alias("_o"))
    old = flights.where(F.col("last_updated") < _stale(as_of, secs)).groupBy("callsign").agg(
        F.count(F.lit(1)).alias("_n")
    )
    both = open_stays.join(old, "callsign", "left")
    return both.agg(
        F.coalesce(F.sum("_o"), F.lit(0)).alias("open_sectors_count"),
        F.coalesce(F.sum(F.col("_o") * F.col("_n")), F.lit(0)).alias("potentially_stale_sectors_count"),
    )


def stale_sector_close(stays: DataFrame, flights: DataFrame, as_of: Column, secs: int = GAP_SECONDS) -> DataFrame:
    """The stays with the stale open ones closed at the aircraft's newest row."""
    stale = F.col("exit_timestamp").isNull() & F.coalesce(F.col("newest") < _stale(as_of, secs), F.lit(False))
    length = F.unix_seconds(F.col("newest").cast("timestamp")) - F.unix_seconds(F.col("entry_timestamp").cast("timestamp"))
    joined = stays.join(newest_rows(flights), "callsign", "left").withColumn("_stale", stale)

    def fill(name: str, value: Column) -> Column:
        return F.when(F.col("_stale"), value).otherwise(F.col(name)).alias(name)

    new = {
        "exit_timestamp": F.col("newest"), "exit_lat": F.col("new_lat"), "exit_lon": F.col("new_lon"),
        "exit_altitude": F.col("new_altitude"), "duration_seconds": length.cast("int"),
    }
    return joined.select(*[fill(c, new[c]) if c in new else F.col(c) for c in stays.columns])


def sector_exit(stays: DataFrame, exits: DataFrame) -> DataFrame:
    """Close named open stays: ``exits`` has callsign, sector_name and the exit.

    If an aircraft has several exits for one sector the latest is taken.
    """
    names = ["exit_timestamp", "exit_lat", "exit_lon", "exit_altitude"]
    newest = exits.groupBy("callsign", "sector_name").agg(F.max(F.struct(*names)).alias("_x"))
    joined = stays.join(newest, ["callsign", "sector_name"], "left")
    closing = F.col("exit_timestamp").isNull() & F.col("_x").isNotNull()
    length = F.unix_seconds(F.col("_x.exit_timestamp").cast("timestamp")) - F.unix_seconds(
        F.col("entry_timestamp").cast("timestamp")
    )

    def fill(name: str) -> Column:
        if name in names:
            return F.when(closing, F.col(f"_x.{name}")).otherwise(F.col(name)).alias(name)
        if name == "duration_seconds":
            return F.when(closing, length.cast("int")).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[fill(c) for c in stays.columns])


FLIGHT_SPAN = ["callsign", "logon_time", "completion_time"]


def sector_breakdown(stays: DataFrame, flights: DataFrame) -> DataFrame:
    """Whole minutes per sector for each flight (callsign, log-on, completion).

    Only closed stays that start within the flight count, and only sums of a
    minute or more are kept.
    """
    from airtrace.operators.bandjoin import range_join

    spans = flights.select(
        F.col("callsign").alias("flight_callsign"), "logon_time", "completion_time"
    ).dropna().distinct()
    closed = stays.where(F.col("exit_timestamp").isNotNull())
    inside = range_join(
        closed, spans, "entry_timestamp", "logon_time", "completion_time", on=[("callsign", "flight_callsign")]
    )
    sums = inside.groupBy(*FLIGHT_SPAN, "sector_name").agg(F.sum("duration_seconds").alias("_s"))
    return sums.withColumn("minutes", (F.col("_s") / 60).cast("int")).where("minutes > 0").drop("_s")


def primary_sector(breakdown: DataFrame) -> DataFrame:
    """Sector with the most minutes per flight; ties go to the first name."""
    best = F.min_by("sector_name", F.struct(-F.col("minutes"), F.col("sector_name")))
    return breakdown.groupBy(*FLIGHT_SPAN).agg(
        best.alias("primary_sector"),
        F.count(F.lit(1)).cast("int").alias("total_sectors"),
        F.sum("minutes").cast("int").alias("total_minutes"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sector_name", "minutes")))).alias("sector_breakdown"),
    )
