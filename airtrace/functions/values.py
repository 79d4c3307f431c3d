"""Text, time, frequency and JSON-object helpers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T


def at(as_of: datetime | str) -> Column:
    """The report clock as a timestamp literal; it replaces NOW()."""
    return F.lit(str(as_of)).cast("timestamp")


def ago(as_of: datetime | str, **parts: float) -> Column:
    """``as_of`` minus days, hours, mins, secs, weeks or months."""
    return at(as_of) - F.make_interval(**{k: F.lit(v) for k, v in parts.items()})


def upto(df: DataFrame, time: str, as_of: datetime | str) -> DataFrame:
    """The rows there were at ``as_of``, so that a run for a past hour gives what it gave then."""
    return df.where(F.col(time) <= at(as_of))


def stable_id(*columns) -> Column:
    """A row number that the row itself decides, so a repeated run gives it again."""
    return F.xxhash64(*columns)


def parse_utc(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp with whole seconds; bad text is NULL."""
    return F.date_trunc("second", F.try_to_timestamp(text))


def khz(hz: Column) -> Column:
    """Hz rounded to whole kHz, half to even, on integers."""
    whole = F.floor(hz / 1000).cast("long")
    rest = F.pmod(hz, F.lit(1000))
    up = (rest > 500) | ((rest == 500) & (F.pmod(whole, F.lit(2)) == 1))
    return whole + F.when(up, 1).otherwise(0)


def object_keys(df: DataFrame, name: str) -> Column:
    """Keys of a map column, or of a column that holds a JSON object as text."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.map_keys(F.col(name))
    return F.json_object_keys(F.col(name))


def object_text(df: DataFrame, name: str) -> Column:
    """The JSON text of a map column or of a text column."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.to_json(F.col(name))
    return F.col(name)


def detail_callsigns(df: DataFrame, name: str) -> Column:
    """The ``callsign`` field of each element of an array (or its JSON text)."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name)["callsign"]
    return F.from_json(F.col(name), "array<struct<callsign:string>>")["callsign"]


def nonblank(col: Column) -> Column:
    return col.isNotNull() & (col != "")
