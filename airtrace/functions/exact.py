"""Rounded ratios computed on exact decimals, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded_ratio(num: Column, den: Column, digits: int, factor: int = 1) -> Column:
    """round(num * factor / den, digits) as double; NULL where den is 0.

    ``num`` may have up to two decimals. The quotient keeps 14 or more decimal
    places, so the rounding is the one of exact arithmetic.
    """
    top = num.cast("decimal(22,2)") * F.lit(factor)
    return F.round(F.try_divide(top, den.cast("decimal(20,0)")), digits).cast("double")


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    return rounded_ratio(num, den, digits, 100)


def rounded_avg(col: Column, digits: int) -> Column:
    """AVG over non-null values, rounded (an aggregate)."""
    return rounded_ratio(F.sum(col), F.count(col), digits)


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(col.cast("timestamp"))


def whole_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, cut toward zero."""
    secs = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return (secs / 60).cast("long")
