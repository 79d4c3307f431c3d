"""Share of stored flight rows with ATC contact, by several groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.functions.callsign import position_type, rank_name
from airtrace.functions.exact import percent
from airtrace.operators.contacts import records_by_controller, records_with_contact


def join_totals_left(totals: DataFrame, contacts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals LEFT JOIN contacts with a missing contact count as 0."""
    return totals.join(contacts, keys, "left").withColumn("contact", F.coalesce("contact", F.lit(0)))


def _per_callsign(flights: DataFrame, contact_rows: DataFrame, group: dict[str, Column]) -> DataFrame:
    """(callsign, group columns, total, contact).

    Rows with contact are a part of all rows, so both counts come from one
    grouping over the two lists, with no join.
    """
    columns = [c.alias(n) for n, c in group.items()]

    def marked(rows: DataFrame, total: int, contact: int) -> DataFrame:
        return rows.select("callsign", *columns, F.lit(total).alias("t"), F.lit(contact).alias("c"))

    return (
        marked(flights, 1, 0).unionByName(marked(contact_rows, 0, 1))
        .groupBy("callsign", *group)
        .agg(F.sum("t").alias("total"), F.sum("c").alias("contact"))
    )


def _report(per_callsign: DataFrame, keys: list[str], flights_name: str) -> DataFrame:
    # rows are unique per (callsign, keys), so a plain count is the distinct one
    out = per_callsign.groupBy(*keys).agg(
        F.count("callsign").alias(flights_name),
        F.sum("total").alias("total_flight_data_records"),
        F.sum("contact").alias("flight_data_records_in_contact_with_atc"),
    )
    return out.withColumn(
        "percentage_with_atc",
        percent(F.col("flight_data_records_in_contact_with_atc"), F.col("total_flight_data_records")),
    )


def pct_time_by_aircraft(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    contact = records_with_contact(flights, transceivers, controllers, **kw)
    rows = _per_callsign(flights, contact, {})
    return rows.select(
        "callsign",
        F.col("total").alias("total_flight_data_records"),
        F.col("contact").alias("flight_data_records_in_contact_with_atc"),
        percent(F.col("contact"), F.col("total")).alias("percentage_with_atc"),
    )


def overall_atc_statistics(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    contact = records_with_contact(flights, transceivers, controllers, **kw)
    return _report(_per_callsign(flights, contact, {}), [], "total_flights")


def atc_by_hour(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    contact = records_with_contact(flights, transceivers, controllers, **kw)
    rows = _per_callsign(flights, contact, {"hour_of_day": F.hour("last_updated")})
    return _report(rows, ["hour_of_day"], "total_flights_in_hour")


def atc_by_weekday(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    contact = records_with_contact(flights, transceivers, controllers, **kw)
    rows = _per_callsign(flights, contact, {"weekday_number": F.dayofweek("last_updated") - 1})
    names = F.array(*[F.lit(d) for d in ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")])
    return _report(rows, ["weekday_number"], "total_flights_in_weekday").withColumn(
        "weekday_name", F.get(names, F.col("weekday_number"))
    )


def atc_by_route(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    planned = flights.where(F.col("departure").isNotNull() & F.col("arrival").isNotNull())
    contact = records_with_contact(planned, transceivers, controllers, **kw)
    rows = _per_callsign(planned, contact, {"route": F.concat("departure", F.lit("-"), "arrival")})
    return _report(rows, ["route"], "total_flights_on_route")


def _by_label(flights, transceivers, controllers, label: Column, name: str, flights_name: str, **kw) -> DataFrame:
    """Totals per callsign LEFT JOIN its records per label; no contact is NULL."""
    totals = flights.groupBy("callsign").agg(F.count(F.lit(1)).alias("total"))
    contacts = records_by_controller(flights, transceivers, controllers, label, **kw).select(
        "callsign", F.col("label").alias(name), F.col("records").alias("contact")
    )
    rows = totals.join(contacts, "callsign", "left").withColumn("contact", F.coalesce("contact", F.lit(0)))
    return _report(rows, [name], flights_name)


def atc_by_position(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    label = position_type(F.col("callsign"))
    return _by_label(flights, transceivers, controllers, label, "position_type", "total_flights_with_position", **kw)


def atc_by_rank(flights: DataFrame, transceivers: DataFrame, controllers: DataFrame, **kw) -> DataFrame:
    out = _by_label(
        flights, transceivers, controllers, F.col("rating"), "controller_rank", "total_flights_with_rank", **kw
    )
    return out.withColumn("rank_name", rank_name(F.col("controller_rank")))
