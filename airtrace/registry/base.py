"""Registration of queries next to their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airtrace.registry.derived import Derived, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARED_CTES: dict[str, str] = {}


def shared_cte(name: str, sql: str) -> None:
    """A named sub-query several oracles use."""
    SHARED_CTES[name] = sql


def query(key: str, oracle: str | None = None) -> Callable:
    """Register ``fn(tables)`` under ``key`` with its SQL for DuckDB."""

    def wrap(fn: Callable[[Derived], DataFrame]) -> Callable:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Derived(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = with_ctes(oracle, SHARED_CTES)
        return fn

    return wrap


def ratio_sql(num: str, den: str, digits: int, factor: int = 1) -> str:
    """Half-up rounding of num * factor / den on whole numbers, as double."""
    scale = 10**digits
    return f"(((({num}) * {2 * factor * scale} + ({den})) // nullif(2 * ({den}), 0)) / {scale}.0e0)"


def percent_sql(num: str, den: str, digits: int = 2) -> str:
    return ratio_sql(num, den, digits, 100)


def avg_sql(col: str, digits: int = 1) -> str:
    """Rounded AVG of a whole-number column."""
    return ratio_sql(f"sum({col})", f"count({col})", digits)


def avg2_sql(col: str, digits: int = 1) -> str:
    """Rounded AVG of a column with two decimals."""
    return ratio_sql(f"sum(cast({col} * 100 as bigint))", f"(100 * count({col}))", digits)
