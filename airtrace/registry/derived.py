"""Flight, controller and radio tables derived from the given tables.

The same SQL text runs in Spark and in DuckDB. In Spark each text becomes a
DataFrame over the parquet tables; for DuckDB the texts a query names are put
in front of it as CTEs.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from airtrace.operators.sectors import sector_stays
from airtrace.session import sortable_times
from airtrace.sources.reference import rectangle_sectors

AS_OF_EVENTS = "2024-01-01 03:00:00"
AS_OF_ORDERS = "2001-08-01 00:00:00"

POLLS = "(select *, event_id % 50 as f, cast(floor(event_id / 50e0) as bigint) as p from events) e"
START = "timestamp '2024-01-01 00:00:00'"
PLACE_LAT = "-40e0 + ((p*3 + f*7) % 250)/1e1"
PLACE_LON = "115e0 + ((p*5 + f*11) % 400)/1e1"


def _station(n: str) -> str:
    return (
        f"concat('STN', {n}, case when {n} < 2 then '_GND' when {n} < 4 then '_TWR' "
        f"when {n} < 6 then '_APP' when {n} = 6 then '_CTR' else '_FSS' end)"
    )


DERIVED = {
    "fx_flights": f"""
select event_id as id, concat('FLT', f) as callsign,
 case when f % 9 = 0 then 'B738' when f % 9 = 1 then 'A320' when f % 9 = 2 then 'C172' when f % 9 = 3 then 'F18' when f % 9 = 4 then 'DH8D' when f % 9 = 5 then 'B77W' when f % 9 = 6 then 'A333' when f % 9 = 7 then 'PC12' else 'C130' end as aircraft_type,
 case when event_id % 41 = 0 then cast(null as double) else {PLACE_LAT} end as latitude,
 {PLACE_LON} as longitude,
 cast((event_id*37) % 39000 as int) as altitude, cast((event_id*13) % 361 as int) as heading,
 case when event_id % 37 = 0 then cast(null as int) else cast((cast(floor(value) as bigint)*7) % 480 as int) end as groundspeed,
 case when f % 23 = 22 then '' when f % 5 = 0 then 'YSSY' when f % 5 = 1 then 'YMML' when f % 5 = 2 then 'YBBN' when f % 5 = 3 then 'YPAD' else 'NZAA' end as departure,
 case when f % 4 = 0 then 'YMML' when f % 4 = 1 then 'YSSY' when f % 4 = 2 then 'YPPH' else 'YBBN' end as arrival,
 case when f % 3 = 0 then 'V' else 'I' end as flight_rules,
 case when f % 17 = 16 then cast(null as int) else cast(1100000 + f*37000 as int) end as cid,
 concat('Pilot ', f, case when f % 4 = 0 then ' YSSY' when f % 4 = 1 then ' KLAX' when f % 4 = 2 then ' EGLL' else ' ZBAA' end) as name,
 concat('0', f % 10, '00') as deptime,
 {START} + (f % 7) * interval '1' minute as logon_time,
 {START} + p * interval '1' minute as last_updated
from {POLLS}""",
    "fx_transceivers": f"""
select event_id as id, case when event_type in ('click','purchase') then {_station('event_id % 8')} else concat('FLT', f) end as callsign,
 case when event_type in ('click','purchase') then 'atc' else 'flight' end as entity_type,
 cast(118000000 + (case when event_type in ('click','purchase') then (event_id % 8)*5 else (f*7 + cast(floor(p / 20e0) as bigint)) % 40 end)*25000 + (event_id % 3)*5000 as bigint) as frequency,
 {PLACE_LAT} as position_lat, {PLACE_LON} as position_lon,
 {START} + p * interval '1' minute as ts
from {POLLS}""",
    "fx_controllers": f"""
select event_id as id, {_station('c')} as callsign,
 concat('1', 18 + c, '.', (event_id % 2), '00') as frequency,
 case when c = 5 then cast(null as int) else cast(800000 + c as int) end as cid, concat('Controller ', c) as name,
 cast(1 + c as int) as rating, cast(c % 7 as int) as facility,
 {START} + (cast(floor(p / 6e0) as bigint) * 6) * interval '1' minute as logon_time,
 {START} + p * interval '1' minute as last_updated
from (select *, event_id % 8 as c, cast(floor(event_id / 50e0) as bigint) as p from events where event_type in ('click','purchase')) e""",
    "fx_flight_summaries": """
select o_orderkey as id, concat('FLT', o_custkey % 60) as callsign,
 case when o_orderkey % 7 = 0 then 'B738' when o_orderkey % 7 = 1 then 'A320' when o_orderkey % 7 = 2 then 'C172' when o_orderkey % 7 = 3 then 'F18S' when o_orderkey % 7 = 4 then 'DH8D' when o_orderkey % 7 = 5 then '' else 'C130' end as aircraft_type,
 case when o_custkey % 4 = 0 then 'YSSY' when o_custkey % 4 = 1 then 'YMML' when o_custkey % 4 = 2 then 'YBBN' else '' end as departure,
 case when o_orderkey % 3 = 0 then 'YMML' when o_orderkey % 3 = 1 then 'YSSY' else 'YPPH' end as arrival,
 case when o_orderpriority = '5-LOW' then 'V' else 'I' end as flight_rules,
 cast(900000 + o_custkey*700 as int) as cid,
 concat('Pilot ', o_custkey, case when o_custkey % 5 = 0 then ' YSSY' when o_custkey % 5 = 1 then ' KLAX' when o_custkey % 5 = 2 then ' EGLL' when o_custkey % 5 = 3 then ' ZBAA' else ' NZAA' end) as name,
 concat('0', o_orderkey % 10, '00') as deptime,
 cast(cast(floor(o_totalprice) as bigint) % 600 as int) as time_online_minutes,
 cast(cast(floor(o_totalprice) as bigint) % 300 as int) as total_enroute_time_minutes,
 cast((cast(floor(o_totalprice) as bigint) % 1001)/1e1 as decimal(5,2)) as controller_time_percentage,
 case when o_orderkey % 5 = 0 then '{}' when o_orderkey % 5 = 1 then cast(null as varchar(100)) when o_orderkey % 5 = 2 then '{"SY_TWR":{"type":"TWR"},"ML_TWR":{"type":"TWR"},"SY_GND":{"type":"GND"},"ML_GND":{"type":"GND"},"ML_CTR":{"type":"CTR"}}' when o_orderkey % 5 = 3 then '{"SY_TWR":{"type":"TWR"}}' else concat('{"STN', o_orderkey % 8, '_TWR":{"type":"TWR"}}') end as controller_callsigns,
 o_orderdate - (cast(floor(o_totalprice) as bigint) % 600) * interval '1' minute as logon_time, o_orderdate as completion_time
from orders""",
    "fx_controller_summaries": f"""
select l_orderkey*10 + l_linenumber as id, {_station('l_suppkey % 8')} as callsign,
 cast(l_suppkey as int) as cid, concat('Controller ', l_suppkey) as name, cast(1 + l_suppkey % 11 as int) as rating,
 cast(l_suppkey % 7 as int) as facility,
 cast(cast(floor(l_extendedprice) as bigint) % 400 as int) as session_duration_minutes,
 cast(l_quantity as int) as total_aircraft_handled, cast(l_quantity as int) as peak_aircraft_count,
 concat('[{{"callsign":"FLT', l_partkey % 60, '"}}]') as aircraft_details,
 l_shipdate as session_start_time, l_shipdate + (cast(floor(l_extendedprice) as bigint) % 400) * interval '1' minute as session_end_time
from lineitem""",
    # archived sessions: those before 1997, some with a log-on a minute off
    "fx_controllers_archive": f"""
select l_orderkey*10 + l_linenumber as id, {_station('l_suppkey % 8')} as callsign,
 cast(l_suppkey as int) as cid, cast(1 + l_suppkey % 11 as int) as rating,
 case when l_linenumber % 3 = 0 then l_shipdate + interval '1' minute else l_shipdate end as logon_time,
 l_shipdate + interval '2' hour as last_updated
from lineitem where l_shipdate < timestamp '1997-01-01 00:00:00'""",
    # archived flight rows: those before 1998, summary columns partly missing
    "fx_flights_archive": """
select o_orderkey as id, concat('FLT', o_custkey % 60) as callsign,
 case when o_custkey % 4 = 0 then 'YSSY' when o_custkey % 4 = 1 then 'YMML' when o_custkey % 4 = 2 then 'YBBN' else '' end as departure,
 case when o_orderkey % 3 = 0 then 'YMML' when o_orderkey % 3 = 1 then 'YSSY' else 'YPPH' end as arrival,
 cast(900000 + o_custkey*700 as int) as cid, concat('0', o_orderkey % 10, '00') as deptime,
 case when o_orderkey % 4 = 0 then cast(null as int) else 1 end as time_online_minutes,
 case when o_orderkey % 6 = 0 then cast(null as int) else 2 end as total_enroute_time_minutes,
 case when o_orderkey % 4 = 1 then cast(null as timestamp) else o_orderdate end as completion_time,
 o_orderdate as last_updated
from orders where o_orderdate < timestamp '1998-01-01 00:00:00'""",
    # three rectangles; the union of literals is the reference data, not a query
    "fx_sectors": """
select 1 as ord, 'ARL' as sector_name, 'A' as main_sector, 115e0 as lon_min, 130e0 as lon_max, -40e0 as lat_min, -15e0 as lat_max
union all select 2, 'WOL', 'A', 128e0, 145e0, -40e0, -25e0
union all select 3, 'KEN', 'B', 130e0, 155e0, -27e0, -15e0""",
}


def _sources(sql: str) -> list[str]:
    return [t for t in ("events", "orders", "lineitem") if re.search(rf"\bfrom {t}\b", sql)]


# Folders of derived tables that were written out, by folder of the given tables.
STORED: dict[str, str] = {}
TIMES = {
    "fx_flights": "last_updated", "fx_transceivers": "ts", "fx_controllers": "last_updated",
    "fx_flight_summaries": "completion_time", "fx_controller_summaries": "session_start_time",
    "fx_controllers_archive": "logon_time", "fx_flights_archive": "last_updated",
}


def store(spark: SparkSession, sf_dir: str, out: str, parts: int = 8) -> None:
    """Write the large derived tables and the sector stays, in time order, and
    read them from there on: they then are stored tables, as in use, and not
    views over others."""
    tables = Derived(spark, sf_dir)
    with sortable_times(spark):
        for name, time in TIMES.items():
            tables.derived(name).repartitionByRange(parts, time).sortWithinPartitions(time).write.parquet(f"{out}/{name}")
    STORED[sf_dir] = out
    stays = tables.computed_stays()
    with sortable_times(spark):
        stays.repartitionByRange(parts, "entry_timestamp").write.parquet(f"{out}/stays")


class Derived:
    """The derived tables as DataFrames under the library's column names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def sql(self, text: str) -> DataFrame:
        """Run derived SQL text with the parquet tables as named arguments."""
        sources = _sources(text)
        marked = text
        for name in sources:
            marked = re.sub(rf"\bfrom {name}\b", f"from <<{name}>>", marked)
        marked = marked.replace("{", "{{").replace("}", "}}")
        marked = re.sub(r"<<(\w+)>>", r"{\1}", marked)
        out = self.spark.sql(marked, **{n: self.table(n) for n in sources})
        times = {f.name: F.col(f.name).cast("timestamp") for f in out.schema if "timestamp" in f.dataType.simpleString()}
        return out.withColumns(times) if times else out

    def derived(self, name: str) -> DataFrame:
        """One derived table, from its stored form where there is one."""
        if self.dir in STORED and name in TIMES:
            return self.spark.read.parquet(f"{STORED[self.dir]}/{name}")
        return self.sql(DERIVED[name])

    def computed_stays(self) -> DataFrame:
        return sector_stays(self.flights, rectangle_sectors(self.sector_rectangles))

    @cached_property
    def stays(self) -> DataFrame:
        """The sector stays, which in use are a stored table."""
        if self.dir in STORED:
            return self.spark.read.parquet(f"{STORED[self.dir]}/stays")
        return self.computed_stays()

    @cached_property
    def flights(self) -> DataFrame:
        return self.derived("fx_flights")

    @cached_property
    def transceivers(self) -> DataFrame:
        return self.derived("fx_transceivers").withColumnRenamed("ts", "timestamp")

    @cached_property
    def controllers(self) -> DataFrame:
        return self.derived("fx_controllers")

    @cached_property
    def flight_summaries(self) -> DataFrame:
        return self.derived("fx_flight_summaries")

    @cached_property
    def controller_summaries(self) -> DataFrame:
        return self.derived("fx_controller_summaries")

    @cached_property
    def controllers_archive(self) -> DataFrame:
        return self.derived("fx_controllers_archive")

    @cached_property
    def flights_archive(self) -> DataFrame:
        return self.derived("fx_flights_archive")

    @cached_property
    def sector_rectangles(self) -> DataFrame:
        return self.derived("fx_sectors")


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the derived tables (and ``extra`` ones) a query names in front of it."""
    known = {**DERIVED, **(extra or {})}
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name, body in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed[name] = body

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} as ({body.strip()})" for name, body in needed.items())
    return f"with {ctes}\n{sql.strip()}"
