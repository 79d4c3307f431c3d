"""Checks that the two kinds of summaries, the archives and the stays agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.functions.exact import micros, percent
from airtrace.functions.values import at, detail_callsigns, object_keys, object_text
from airtrace.operators.bandjoin import Band, band_join
from airtrace.operators.contacts import flight_radios, relevant_atc_rows
from airtrace.session import BROADCAST_ROWS

# Slots of the overlap joins: an interval is listed once per slot it touches.
SLOT_HOURS = 12

# A join with a quadratic result is dealt out in pieces of about so many rows, over at most so many tasks.
ROWS_PER_PIECE = 1_000_000
MOST_TASKS = 2_000
# A result of no more pieces is left to Spark.
FEW_PIECES = 8


def _slots(start: str, end: str) -> Column:
    """The slots between both ends, whichever comes first."""
    width = SLOT_HOURS * 3600

    def slot(name: str) -> Column:
        return F.floor(F.unix_seconds(F.col(name).cast("timestamp")) / width)

    return F.explode(F.sequence(F.least(slot(start), slot(end)), F.greatest(slot(start), slot(end))))


def overlaps(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_span, right_span, keep: str) -> DataFrame:
    """Ids (column ``keep``) of left rows with a right row of equal keys whose
    time overlaps; each time slot is joined on its own, so a pair of keys with
    very many rows is spread over its slots. A span that ends before it starts
    overlaps what both of its ends lie in, and is listed in all slots between."""
    l = left.withColumn("_slot", _slots(*left_span))
    r = right.withColumn("_slot", _slots(*right_span))
    test = F.col("l._slot") == F.col("r._slot")
    for a, b in on:
        test = test & (F.col(f"l.{a}") == F.col(f"r.{b}"))
    test = test & (F.col(f"r.{right_span[0]}") <= F.col(f"l.{left_span[1]}"))
    test = test & (F.col(f"r.{right_span[1]}") >= F.col(f"l.{left_span[0]}"))
    return l.alias("l").join(r.alias("r"), test, "left_semi").select(keep).distinct()


def flight_references(summaries: DataFrame, start, end, as_of) -> DataFrame:
    """(flight, controller named in its map) for flights in the time window."""
    rows = summaries.withColumn("completion_time", F.coalesce("completion_time", at(as_of)))
    rows = rows.where((F.col("logon_time") <= at(end)) & (F.col("completion_time") >= at(start)))
    return rows.select(
        F.col("id").alias("flight_summary_id"), F.col("callsign").alias("flight_callsign"),
        "logon_time", "completion_time",
        F.explode(object_keys(summaries, "controller_callsigns")).alias("controller_callsign"),
    )


def session_references(summaries: DataFrame, start, end, as_of) -> DataFrame:
    """(session, aircraft named in its details) for sessions in the window."""
    rows = summaries.withColumn("session_end_time", F.coalesce("session_end_time", at(as_of)))
    rows = rows.where((F.col("session_start_time") <= at(end)) & (F.col("session_end_time") >= at(start)))
    return rows.select(
        F.col("id").alias("controller_summary_id"), F.col("callsign").alias("controller_callsign"),
        "session_start_time", "session_end_time",
        F.explode(detail_callsigns(summaries, "aircraft_details")).alias("flight_callsign"),
    )


def integrity_flight_to_controller(
    flight_summaries: DataFrame, controller_summaries: DataFrame, start, end, as_of
) -> DataFrame:
    """Controllers named by a flight without an overlapping session naming it."""
    refs = flight_references(flight_summaries, start, end, as_of).withColumn(
        "_ref", F.struct("flight_summary_id", "controller_callsign")
    )
    sessions = controller_summaries.select(
        F.col("callsign").alias("session_callsign"), "session_start_time",
        # a session without an end overlaps everything after its start
        F.coalesce("session_end_time", F.greatest(at(as_of), F.col("session_start_time"))).alias("session_end_time"),
        F.explode(F.array_distinct(detail_callsigns(controller_summaries, "aircraft_details"))).alias("seen_callsign"),
    )
    # only sessions inside the span of the flights can overlap one
    sessions = sessions.where(
        (F.col("session_start_time") <= refs.agg(F.max("completion_time")).scalar())
        & (F.col("session_end_time") >= refs.agg(F.min("logon_time")).scalar())
    )
    good = overlaps(
        refs, sessions, [("controller_callsign", "session_callsign"), ("flight_callsign", "seen_callsign")],
        ("logon_time", "completion_time"), ("session_start_time", "session_end_time"), "_ref",
    )
    return refs.join(good, "_ref", "left_anti").drop("_ref")


def integrity_controller_to_flight(
    flight_summaries: DataFrame, controller_summaries: DataFrame, start, end, as_of
) -> DataFrame:
    """Aircraft named by a session for which an overlapping flight summary is
    missing, or does not name the controller back (one row per such summary)."""
    refs = session_references(controller_summaries, start, end, as_of)
    text = object_text(flight_summaries, "controller_callsigns")
    keys = object_keys(flight_summaries, "controller_callsigns")
    flights = flight_summaries.select(
        F.col("callsign").alias("fs_callsign"), F.col("logon_time").alias("fs_start"),
        F.coalesce("completion_time", at(as_of)).alias("fs_end"),
        F.when(text.isNotNull(), keys).alias("_keys"),
    )
    width = SLOT_HOURS * 3600

    def slot(name: str) -> Column:
        return F.floor(F.unix_seconds(F.col(name).cast("timestamp")) / width)

    def first(start: str, end: str) -> Column:
        return F.least(slot(start), slot(end))

    l = refs.withColumn("_slot", _slots("session_start_time", "session_end_time"))
    r = flights.withColumn("_slot", _slots("fs_start", "fs_end"))
    pair = (
        (F.col("flight_callsign") == F.col("fs_callsign"))
        & (F.col("l._slot") == F.col("r._slot"))
        & (F.col("fs_start") <= F.col("session_end_time"))
        & (F.col("fs_end") >= F.col("session_start_time"))
        # a pair is taken only in the first slot both touch
        & (F.col("l._slot") == F.greatest(first("session_start_time", "session_end_time"), first("fs_start", "fs_end")))
    )
    found = l.alias("l").join(r.alias("r"), pair).select(
        *[F.col(f"l.{c}") for c in refs.columns],
        F.coalesce(F.array_contains("_keys", F.col("controller_callsign")), F.lit(False)).alias("_named"),
    )
    columns = refs.columns
    # sessions repeat few aircraft, so the verdict per reference is a small group
    verdict = found.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("_found"), F.count_if(~F.col("_named")).alias("_unnamed")
    )
    counted = refs.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    both = counted.join(verdict, columns, "left")
    # per copy: one row when nothing was found, else one per unnamed summary
    copies = F.when(F.col("_found").isNull(), F.col("_copies")).otherwise(F.col("_unnamed"))
    return both.where(copies > 0).withColumn("_n", copies).select(
        *columns, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")
    ).drop("_i")


def archive_vs_summary(archive: DataFrame, summaries: DataFrame, most: int = ROWS_PER_PIECE) -> DataFrame:
    """Archived sessions LEFT JOIN summaries on callsign and start.

    The rows of a key are its sessions times its summaries, which the sizes of
    the inputs do not show. They are counted first; where they are many, the
    tasks are made by their number, and the sessions of a key with more than
    ``most`` of them are dealt out over several pieces.
    """
    cs = summaries.select(
        F.col("callsign").alias("_c"), "session_start_time", "session_duration_minutes", "total_aircraft_handled"
    )
    rows = archive.where(F.col("logon_time").isNotNull())
    same = (F.col("callsign") == F.col("_c")) & (F.col("logon_time") == F.col("session_start_time"))
    a = rows.groupBy("callsign", "logon_time").agg(F.count(F.lit(1)).alias("_a"))
    s = cs.groupBy("_c", "session_start_time").agg(F.count(F.lit(1)).alias("_s"))
    # as doubles: a product of counts may pass the end of a long
    counted = a.join(s, same).select(
        F.col("callsign").alias("_callsign"), F.col("logon_time").alias("_start"),
        (F.col("_a").cast("double") * F.col("_s")).alias("_rows"),
    )
    large = F.col("_rows") > most
    total, keys = counted.agg(F.coalesce(F.sum("_rows"), F.lit(0.0)), F.count_if(large)).first()
    if total <= FEW_PIECES * most:
        return rows.join(cs, same, "left").drop("_c")
    tasks = min(math.ceil(total / most), MOST_TASKS)
    if not keys:
        l, r = rows.repartition(tasks, "callsign", "logon_time"), cs.repartition(tasks, "_c", "session_start_time")
        return l.join(r, same, "left").drop("_c")
    pieces = counted.where(large).select("_callsign", "_start", F.ceil(F.col("_rows") / most).cast("int").alias("_pieces"))
    if keys <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    n = F.coalesce(F.col("_pieces"), F.lit(1))

    def cut(df: DataFrame, callsign: str, start: str, piece: Column, name: str) -> DataFrame:
        known = (F.col(callsign) == F.col("_callsign")) & (F.col(start) == F.col("_start"))
        cuts = df.join(pieces, known, "left").select(*df.columns, piece.alias(name))
        return cuts.repartition(tasks, callsign, start, name)

    l = cut(rows, "callsign", "logon_time", F.pmod(F.xxhash64(*rows.columns), n).cast("int"), "_piece")
    r = cut(cs, "_c", "session_start_time", F.explode(F.sequence(F.lit(0), n - 1)), "_p")
    return l.join(r, same & (F.col("_piece") == F.col("_p")), "left").drop("_c", "_piece", "_p")


def session_set_diff(archive: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sessions only in the archive (missing) and only in the summaries (extra).

    One grouping over both lists replaces two set differences.
    """
    a = archive.select("callsign", F.col("logon_time").alias("session_start"), F.lit(1).alias("a"), F.lit(0).alias("s"))
    s = summaries.select(
        "callsign", F.col("session_start_time").alias("session_start"), F.lit(0).alias("a"), F.lit(1).alias("s")
    )
    both = a.unionByName(s).groupBy("callsign", "session_start").agg(F.max("a").alias("a"), F.max("s").alias("s"))
    side = F.when(F.col("s") == 0, "missing_summary").when(F.col("a") == 0, "extra_summary")
    return both.select("callsign", "session_start", side.alias("side")).where("side is not null")


def coverage_set_diff(plan_a: DataFrame, plan_b: DataFrame) -> DataFrame:
    """Callsigns of two plans: common, missing, extra and the share covered."""
    a = plan_a.select("callsign", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = plan_b.select("callsign", F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = a.unionByName(b).groupBy("callsign").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    in_a, in_b = F.col("a") == 1, F.col("b") == 1
    return both.agg(
        F.count_if(in_a).alias("callsigns_a"),
        F.count_if(in_b).alias("callsigns_b"),
        F.count_if(in_a & in_b).alias("common"),
        F.count_if(in_a & ~in_b).alias("missing_in_b"),
        F.count_if(in_b & ~in_a).alias("extra_in_b"),
        percent(F.count_if(in_a & in_b), F.count_if(in_a), 1).alias("coverage_percent"),
    )


def join_vs_semi_audit(transceivers: DataFrame, controllers: DataFrame) -> DataFrame:
    """Rows, callsigns and frequencies of the JOIN form against the IN form.

    The joined rows are counted from the number of rows per callsign on both
    sides; the product itself is never built.
    """
    staffed = controllers.where(F.col("facility") != 0).groupBy("callsign").agg(F.count(F.lit(1)).alias("_w"))
    # distinct pairs first: a count per (callsign, frequency) has few rows
    radios = transceivers.where(F.col("entity_type") == "atc").groupBy("callsign", "frequency").agg(
        F.count(F.lit(1)).alias("_n")
    )
    rows = radios.join(staffed, "callsign")
    return rows.agg(
        F.coalesce(F.sum(F.col("_n") * F.col("_w")), F.lit(0)).alias("join_rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("semi_rows"),
        F.countDistinct("callsign").alias("callsigns"),
        F.countDistinct("frequency").alias("frequencies"),
        F.countDistinct("callsign", "frequency").alias("callsign_frequencies"),
    )


def match_exact_frequency(transceivers: DataFrame, controllers: DataFrame, secs: int = 180, degrees: float = 300.0) -> DataFrame:
    """Number of flight and ATC radio rows on the same Hz, near in time and place."""
    from airtrace.functions.geo import deg_within

    flight = flight_radios(transceivers).select(
        F.col("frequency").alias("f_hz"), F.col("position_lat").alias("f_lat"),
        F.col("position_lon").alias("f_lon"), micros(F.col("timestamp")).alias("_us"),
    )
    atc = relevant_atc_rows(transceivers, controllers).select(
        F.col("frequency").alias("a_hz"), F.col("position_lat").alias("a_lat"),
        F.col("position_lon").alias("a_lon"), micros(F.col("timestamp")).alias("_atc_us"),
    )
    # equal rows of a side are summed up first, the numbers are multiplied after the join
    flight = flight.groupBy(*flight.columns).agg(F.count(F.lit(1)).alias("_fw"))
    atc = atc.groupBy(*atc.columns).agg(F.count(F.lit(1)).alias("_aw"))
    pairs = band_join(
        flight, atc, [Band("_us", "_atc_us", secs * 1_000_000)], on=[("f_hz", "a_hz")],
        condition=lambda l, r: deg_within(l("f_lat"), l("f_lon"), r("a_lat"), r("a_lon"), degrees),
    )
    return pairs.agg(F.coalesce(F.sum(F.col("_fw") * F.col("_aw")), F.lit(0)).alias("matches"))


def backfill_stay_cid(stays: DataFrame, flights: DataFrame, summaries: DataFrame, unknown: int = 999999) -> DataFrame:
    """Fill a stay's cid: from a flight row whose log-on to last update holds the
    entry, else from the summaries of the callsign, else ``unknown``.

    Where several fit, the smallest cid is taken. Flight rows are reduced to
    one span per (callsign, cid, log-on) first: spans of one log-on nest, so
    the longest one stands for all.
    """
    spans = flights.where(F.col("cid").isNotNull()).groupBy(
        F.col("callsign").alias("f_callsign"), "cid", "logon_time"
    ).agg(F.max(F.coalesce("last_updated", F.col("logon_time") + F.expr("interval 24 hours"))).alias("until"))
    entries = stays.select("callsign", "entry_timestamp").distinct()
    from airtrace.operators.bandjoin import range_join

    by_flight = range_join(
        entries, spans, "entry_timestamp", "logon_time", "until", on=[("callsign", "f_callsign")]
    ).groupBy("callsign", "entry_timestamp").agg(F.min("cid").alias("_flight_cid"))
    by_summary = summaries.where(F.col("cid").isNotNull()).groupBy("callsign").agg(F.min("cid").alias("_summary_cid"))
    return (
        stays.join(by_flight, ["callsign", "entry_timestamp"], "left")
        .join(by_summary, "callsign", "left")
        .withColumn("cid", F.coalesce("_flight_cid", "_summary_cid", F.lit(unknown)))
        .drop("_flight_cid", "_summary_cid")
    )


def orphan_stays(stays_with_cid: DataFrame, flights: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stays whose cid is in neither flights nor summaries.

    The known ids are distinct before they are joined, so no id is hot.
    """
    known = flights.select("cid").unionByName(summaries.select("cid")).distinct()
    return stays_with_cid.join(known, "cid", "left_anti")
