"""Who talked to whom: radio matching and what is derived from it.

Two forms are needed. Reports that ask "was there any contact" use semi-joins,
which never write out the matching pairs. Counts per label sum up both sides
first, to one row per place, frequency and time with a weight, and multiply the
weights after the join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.functions.callsign import contact_type, controller_type, proximity_nm
from airtrace.functions.exact import micros, rounded_ratio, whole_minutes
from airtrace.functions.geo import deg_within, nm_within
from airtrace.operators.bandjoin import Band, band_join, range_join, sweep_join, within_span
from airtrace.operators.grid import place_cell, with_reach_cells

# Two radios match within 5 kHz and 180 s; reports use 300 degrees.
FREQUENCY_HZ = 5000
TIME_SECONDS = 180
REPORT_DEGREES = 300.0

FLIGHT_KEY = ["callsign", "departure", "arrival", "logon_time"]


def _time_band(seconds: int, left: str = "_us", right: str = "_atc_us") -> Band:
    return Band(left, right, seconds * 1_000_000)


def flight_radios(transceivers: DataFrame) -> DataFrame:
    return transceivers.where(F.col("entity_type") == "flight")


def relevant_atc_rows(transceivers: DataFrame, controllers: DataFrame, since: Column | None = None) -> DataFrame:
    """ATC radio rows of callsigns that hold a real position (facility not 0).

    With ``since`` only controllers seen at or after that time count.
    """
    staffed = controllers.where(F.col("facility") != 0)
    if since is not None:
        staffed = staffed.where(F.col("last_updated") >= since)
        transceivers = transceivers.where(F.col("timestamp") >= since)
    return transceivers.where(F.col("entity_type") == "atc").join(
        staffed.select("callsign").distinct(), "callsign", "left_semi"
    )


def _atc_side(rows: DataFrame, *extra: str) -> DataFrame:
    """ATC rows under names of their own."""
    return (
        rows.select(
            F.col("callsign").alias("atc_callsign"),
            F.col("frequency").alias("atc_frequency"),
            F.col("position_lat").alias("atc_lat"),
            F.col("position_lon").alias("atc_lon"),
            F.col("timestamp").alias("atc_time"),
            micros(F.col("timestamp")).alias("_atc_us"),
            *extra,
        )
    )


def _flight_side(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        "id",
        F.col("callsign").alias("flight_callsign"),
        "frequency",
        F.col("position_lat").alias("flight_lat"),
        F.col("position_lon").alias("flight_lon"),
        F.col("timestamp").alias("flight_time"),
        micros(F.col("timestamp")).alias("_us"),
        *extra,
    )


def _degrees(l, r) -> Column:
    return deg_within(l("flight_lat"), l("flight_lon"), r("atc_lat"), r("atc_lon"), REPORT_DEGREES)


_FREQUENCY_BAND = Band("frequency", "atc_frequency", FREQUENCY_HZ)


def report_match_all(
    transceivers: DataFrame, controllers: DataFrame, secs: int = TIME_SECONDS, pieces: int = 1
) -> DataFrame:
    """Every pair of flight and ATC radio rows that match, one row per pair."""
    return band_join(
        _flight_side(flight_radios(transceivers)),
        _atc_side(relevant_atc_rows(transceivers, controllers)),
        [_FREQUENCY_BAND, _time_band(secs)],
        condition=_degrees,
        pieces=pieces,
    ).drop("_us", "_atc_us")


def matched_flight_times(
    transceivers: DataFrame, controllers: DataFrame, secs: int = TIME_SECONDS, pieces: int = 1
) -> DataFrame:
    """(callsign, time) of flight radio rows with at least one match.

    A row per radio row: the semi-joins on it need no distinct, which would
    cost a shuffle of its own.
    """
    atc = _atc_side(relevant_atc_rows(transceivers, controllers)).drop("atc_callsign", "atc_time")
    matched = band_join(
        _flight_side(flight_radios(transceivers)),
        atc,
        [_FREQUENCY_BAND, _time_band(secs)],
        how="left_semi",
        condition=_degrees,
        pieces=pieces,
    )
    return matched.select("flight_callsign", F.col("_us").alias("_match_us"))


def records_with_contact(
    flights: DataFrame,
    transceivers: DataFrame,
    controllers: DataFrame,
    secs: int = TIME_SECONDS,
    pieces: int = 1,
) -> DataFrame:
    """Flight rows for which the aircraft had a radio match within ``secs``."""
    matched = matched_flight_times(transceivers, controllers, secs, pieces)
    timed = flights.withColumn("_us", micros(F.col("last_updated")))
    return band_join(
        timed,
        matched,
        [Band("_us", "_match_us", secs * 1_000_000)],
        on=[("callsign", "flight_callsign")],
        how="left_semi",
        pieces=pieces,
    ).drop("_us")


def records_by_controller(
    flights: DataFrame,
    transceivers: DataFrame,
    controllers: DataFrame,
    label: Column,
    secs: int = TIME_SECONDS,
    pieces: int = 1,
) -> DataFrame:
    """(callsign, label, records): flight rows x matches x controller rows.

    Every combination counts, as in the inner joins it stands for. Stations are
    summed to a weight per label, place, frequency and time, aircraft likewise,
    before the band join; the weights are multiplied after it.
    """
    staffed = controllers.where(F.col("facility") != 0)
    weights = staffed.groupBy("callsign", label.alias("label")).agg(F.count(F.lit(1)).alias("_w"))
    place = ["frequency", "position_lat", "position_lon", "timestamp"]
    aircraft = flight_radios(transceivers).groupBy("callsign", *place).agg(F.count(F.lit(1)).alias("_fw"))
    stations = (
        relevant_atc_rows(transceivers, controllers)
        .groupBy("callsign", *place).agg(F.count(F.lit(1)).alias("_n"))
        .join(weights, "callsign")
        .groupBy("label", *place).agg(F.sum(F.col("_n") * F.col("_w")).alias("_aw"))
    )
    pairs = band_join(
        _flight_side(aircraft.withColumn("id", F.lit(0)), "_fw").drop("id", "flight_time"),
        _atc_side(stations.withColumn("callsign", F.lit("")), "label", "_aw").drop("atc_callsign", "atc_time"),
        [_FREQUENCY_BAND, _time_band(secs)], condition=_degrees, pieces=pieces,
    )
    matches = pairs.groupBy("flight_callsign", "label", F.col("_us").alias("_match_us")).agg(
        F.sum(F.col("_fw") * F.col("_aw")).alias("_mw")
    )
    rows = flights.groupBy("callsign", micros(F.col("last_updated")).alias("_us")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    joined = band_join(
        rows,
        matches,
        [Band("_us", "_match_us", secs * 1_000_000)],
        on=[("callsign", "flight_callsign")],
        pieces=pieces,
    )
    return joined.groupBy("callsign", "label").agg(F.sum(F.col("_n") * F.col("_mw")).alias("records"))


def flight_completion_time(flight_summaries: DataFrame) -> DataFrame:
    """Newest stored completion time per flight key."""
    newest = "created_at" if "created_at" in flight_summaries.columns else "id"
    return (
        flight_summaries.where(F.col("completion_time").isNotNull())
        .groupBy(*FLIGHT_KEY)
        .agg(F.max_by("completion_time", F.struct(newest, "id")).alias("completion_time"))
    )


def flight_keys(flights: DataFrame) -> DataFrame:
    """Distinct flights; a NULL in the key can never match and is left out."""
    return flights.select(*FLIGHT_KEY).dropna().distinct()


def _named_keys(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("callsign").alias("key_callsign"), "departure", "arrival", "logon_time", *[
        c for c in keys.columns if c not in FLIGHT_KEY
    ])


def flight_radio_rows(keys: DataFrame, transceivers: DataFrame, as_of: Column, completed: DataFrame | None = None) -> DataFrame:
    """Radio rows of each flight from log-on to completion (or ``as_of``)."""
    spans = keys
    if completed is not None:
        spans = keys.join(completed, FLIGHT_KEY, "left")
        end = F.coalesce(F.col("completion_time"), as_of)
    else:
        end = as_of
    spans = _named_keys(spans.select(*FLIGHT_KEY, end.alias("flight_end")))
    return range_join(
        flight_radios(transceivers), spans, "timestamp", "logon_time", "flight_end",
        on=[("callsign", "key_callsign")],
    ).drop("key_callsign")


def _last_heard(radios: DataFrame) -> DataFrame:
    """Time of the newest radio row per callsign."""
    return radios.groupBy("callsign").agg(F.max("timestamp").alias("heard_until"))


def _stations_in_reach(flights: DataFrame, stations: DataFrame, secs: int, condition, pieces: int) -> DataFrame:
    """Flight and station rows close in frequency, time and place; the cells keep far pairs apart before any is made."""
    return band_join(
        flights.withColumn("_cell", place_cell(F.col("flight_lat"), F.col("flight_lon"))),
        with_reach_cells(stations, "atc_lat", "atc_lon", "limit_nm", "_reach"),
        [_FREQUENCY_BAND, _time_band(secs)], on=[("_cell", "_reach")], condition=condition, pieces=pieces,
    )


def match_flight_atc(
    flights: DataFrame,
    transceivers: DataFrame,
    controllers: DataFrame,
    secs: int = TIME_SECONDS,
    window: str = "logon",
    limits: Mapping[str, int] | None = None,
    keys: DataFrame | None = None,
    pieces: int = 1,
) -> DataFrame:
    """Pairs of flight and ATC radio rows, per flight.

    ``window='logon'`` looks at the ``secs`` around the log-on, ``'flight'`` at
    the time from the first to the last stored row of the flight. The distance
    limit follows the controller type. A controller counts if it was seen, and
    on the radio, at or after the log-on, an aircraft if it was on the radio.
    """
    # The scans of all tables are cut to the times that can matter, by one and the
    # same pair of bounds, which Spark then computes once.
    own = flight_radios(transceivers)
    if window == "logon":
        known = flight_keys(flights) if keys is None else keys
        source, last, slack = (flights if keys is None else keys), "logon_time", 2 * secs
        spans = _named_keys(known)
        heard = _last_heard(within_span(own, "timestamp", source, "logon_time", None, slack)).withColumnRenamed("callsign", "key_callsign")
        spans = spans.join(heard, "key_callsign").where(F.col("heard_until") >= F.col("logon_time"))
        spans = spans.drop("heard_until").withColumn("_logon_us", micros(F.col("logon_time")))
        near = within_span(own, "timestamp", source, "logon_time", last, slack)
        radios = band_join(
            near.withColumn("_us", micros(F.col("timestamp"))), spans,
            [Band("_us", "_logon_us", secs * 1_000_000)],
            on=[("callsign", "key_callsign")], pieces=pieces,
        ).drop("_us", "_logon_us", "key_callsign")
    elif window == "flight":
        source, last, slack = flights.dropna(subset=FLIGHT_KEY), "last_updated", 2 * secs
        if keys is not None:
            source = source.join(keys.select(*FLIGHT_KEY).distinct(), FLIGHT_KEY, "left_semi")
        spans = _named_keys(source.groupBy(*FLIGHT_KEY).agg(F.max("last_updated").alias("flight_end")))
        radios = range_join(
            within_span(own, "timestamp", source, "logon_time", last, slack), spans, "timestamp", "logon_time", "flight_end",
            on=[("callsign", "key_callsign")],
        ).drop("key_callsign", "flight_end")
    else:
        raise ValueError(window)
    staff = within_span(controllers.where(F.col("facility") != 0), "last_updated", source, "logon_time", None, slack)
    seen = staff.groupBy("callsign").agg(F.max("last_updated").alias("seen_until"))
    atc = transceivers.where(F.col("entity_type") == "atc")
    heard = _last_heard(within_span(atc, "timestamp", source, "logon_time", None, slack))
    seen = seen.join(heard, "callsign").select(
        "callsign", F.least("seen_until", "heard_until").alias("active_until")
    )
    atc = within_span(atc, "timestamp", source, "logon_time", last, slack)
    atc = _atc_side(atc.join(seen, "callsign"), "active_until").withColumn(
        "limit_nm", proximity_nm(controller_type(F.col("atc_callsign")), limits)
    )

    def close(l, r) -> Column:
        near = nm_within(l("flight_lat"), l("flight_lon"), r("atc_lat"), r("atc_lon"), r("limit_nm"))
        return near & (r("active_until") >= l("logon_time"))

    return _stations_in_reach(
        _flight_side(radios, "departure", "arrival", "logon_time"), atc, secs, close, pieces
    ).select(
        "flight_callsign", "departure", "arrival", "logon_time", "atc_callsign", "frequency",
        "flight_time", "atc_time", "flight_lat", "flight_lon", "atc_lat", "atc_lon",
        (F.abs(F.col("_us") - F.col("_atc_us")) / 1_000_000).alias("time_diff_seconds"),
    )


def session_radio_rows(sessions: DataFrame, transceivers: DataFrame, entity_type: str = "atc") -> DataFrame:
    """Radio rows inside each session (callsign, session_start, session_end).

    For ``atc`` they are the controller's own rows, for ``flight`` all aircraft.
    """
    rows = transceivers.where(F.col("entity_type") == entity_type)
    spans = sessions.withColumnRenamed("callsign", "session_callsign")
    if entity_type == "atc":
        return range_join(rows, spans, "timestamp", "session_start", "session_end", on=[("callsign", "session_callsign")])
    # no callsign to join on: a busy hour is cut into pieces of its own
    return sweep_join(rows, spans, "timestamp", "session_start", "session_end")


def match_controller_flight(
    sessions: DataFrame,
    transceivers: DataFrame,
    secs: int = TIME_SECONDS,
    limits: Mapping[str, int] | None = None,
    pieces: int = 1,
) -> DataFrame:
    """Pairs of flight and ATC radio rows, both inside the controller's session."""
    # nothing outside the sessions' times is read
    transceivers = within_span(transceivers, "timestamp", sessions, "session_start", "session_end")
    own = session_radio_rows(sessions.select("callsign", "session_start", "session_end"), transceivers)
    atc = _atc_side(own, "session_start", "session_end").withColumn(
        "limit_nm", proximity_nm(controller_type(F.col("atc_callsign")), limits)
    )

    def close(l, r) -> Column:
        near = nm_within(l("flight_lat"), l("flight_lon"), r("atc_lat"), r("atc_lon"), r("limit_nm"))
        return near & l("flight_time").between(r("session_start"), r("session_end"))

    return _stations_in_reach(
        _flight_side(flight_radios(transceivers)), atc, secs, close, pieces
    ).select(
        F.col("atc_callsign").alias("callsign"), "session_start", "session_end",
        "flight_callsign", F.col("atc_frequency").alias("frequency"), "flight_time", "atc_time",
        (F.abs(F.col("_us") - F.col("_atc_us")) / 1_000_000).alias("time_diff_seconds"),
    )


def flight_record_count(flights: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Stored rows per flight key, of the given keys or of all."""
    if keys is not None:
        flights = flights.join(keys.select(*FLIGHT_KEY).distinct(), FLIGHT_KEY, "left_semi")
    return flights.dropna(subset=FLIGHT_KEY).groupBy(*FLIGHT_KEY).agg(F.count(F.lit(1)).alias("record_count"))


def contacts_per_controller(matches: DataFrame, poll_secs: int = 60) -> DataFrame:
    """Per flight and controller: first and last contact, count and minutes."""
    return (
        matches.groupBy(F.col("flight_callsign").alias("callsign"), "departure", "arrival", "logon_time", "atc_callsign")
        .agg(
            F.min("flight_time").alias("first_contact"),
            F.max("flight_time").alias("last_contact"),
            F.count(F.lit(1)).alias("contact_count"),
        )
        .withColumn("type", contact_type(F.col("atc_callsign")))
        .withColumn("time_minutes", F.col("contact_count") * F.lit(poll_secs / 60.0))
    )


def atc_contact_metrics(
    matches: DataFrame, flights: DataFrame, poll_secs: int = 60, keys: DataFrame | None = None
) -> DataFrame:
    """Per flight with contact: the controller map and the share of time.

    With ``keys`` only the rows of those flights are counted.
    """
    per_controller = contacts_per_controller(matches, poll_secs)
    entry = F.struct(
        F.col("atc_callsign").alias("key"),
        F.struct(
            F.col("atc_callsign").alias("callsign"), "type", "time_minutes",
            "first_contact", "last_contact", "contact_count",
        ).alias("value"),
    )
    per_flight = per_controller.groupBy(*FLIGHT_KEY).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("controller_callsigns"),
        F.sum("contact_count").alias("interactions_detected"),
    )
    # minutes = contacts * poll_secs / 60, so the share is exact on whole numbers
    share = F.least(
        F.lit(100.0), rounded_ratio(F.col("interactions_detected") * poll_secs, F.col("record_count") * 60, 1, 100)
    )
    return (
        per_flight.join(flight_record_count(flights, keys), FLIGHT_KEY)
        .withColumn("total_controller_time_minutes", F.col("interactions_detected") * F.lit(poll_secs / 60.0))
        .withColumn("controller_time_percentage", share)
        .withColumn("airborne_controller_time_percentage", F.col("controller_time_percentage"))
    )


SESSION_KEY = ["callsign", "session_start", "session_end"]


def aircraft_per_session(matches: DataFrame) -> DataFrame:
    """Per session and aircraft: first and last seen, updates, whole minutes."""
    return (
        matches.groupBy(*SESSION_KEY, "flight_callsign")
        .agg(
            F.min_by("frequency", F.struct("flight_time", "atc_time", "frequency")).alias("frequency"),
            F.min("flight_time").alias("first_seen"),
            F.max("flight_time").alias("last_seen"),
            F.count(F.lit(1)).alias("updates_count"),
        )
        .withColumn("time_on_frequency_minutes", whole_minutes(F.col("first_seen"), F.col("last_seen")))
    )


def _hourly_map() -> Column:
    """24 counters in one aggregate; hours that wrap past midnight count nowhere."""
    first, last = F.hour("first_seen"), F.hour("last_seen")
    cells = []
    for hour in range(24):
        seen = F.count_if(F.lit(hour).between(first, last)).cast("int")
        cells += [F.lit(hour), seen]
    return F.create_map(*cells)


def hourly_breakdown(aircraft: DataFrame) -> DataFrame:
    """Per session a map of 24 hours to the aircraft on frequency.

    An aircraft counts in each hour from first to last seen.
    """
    return aircraft.groupBy(*SESSION_KEY).agg(_hourly_map().alias("hourly_aircraft_breakdown"))


def aircraft_metrics(matches: DataFrame) -> DataFrame:
    """Per session: aircraft total and peak (the same number), hours, details."""
    detail = F.struct(
        F.col("flight_callsign").alias("callsign"),
        (F.col("frequency") / 1_000_000).alias("frequency_mhz"),
        "first_seen", "last_seen", "time_on_frequency_minutes", "updates_count",
    )
    return aircraft_per_session(matches).groupBy(*SESSION_KEY).agg(
        F.count(F.lit(1)).alias("total_aircraft"),
        F.count(F.lit(1)).alias("peak_count"),
        _hourly_map().alias("hourly_aircraft_breakdown"),
        F.sort_array(F.collect_list(detail)).alias("aircraft_details"),
    )
