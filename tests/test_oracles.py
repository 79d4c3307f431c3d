"""Registered queries against their SQL in DuckDB on the smallest tables.

A spread of queries runs by default; AIRTRACE_ALL=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from airtrace import registry
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SPREAD = """
overall_atc_statistics atc_by_rank match_flight_atc_whole match_controller_flight atc_contact_metrics hourly_breakdown
sector_stays sector_breakdown build_flight_summaries build_controller_summaries process_controllers fill_archive_from_summary
integrity_flight_to_controller integrity_controller_to_flight session_set_diff top_groundspeed military_routes category_stats
fastest_city_pair_monday longest_sessions report_hourly_traffic report_peak_load dq_constraints freshness filter_frequency
src_snapshots ingest_poll sector_stays_stream
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", list(registry.queries()) if os.environ.get("AIRTRACE_ALL") else SPREAD)
def test_query_equals_oracle(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    rows = df.collect()
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracles())


def test_entry(spark):
    assert contract.entry(spark).count() == 1
