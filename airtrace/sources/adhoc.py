"""Read-only ad-hoc SQL over registered tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Words that refuse a query anywhere in its text, and the limits.
REFUSED = ("DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE")
MAX_LIMIT = 10_000


def check_query(sql: str, limit: int) -> None:
    if any(word in sql.upper() for word in REFUSED):
        raise ValueError("Dangerous query")
    if not sql.strip():
        raise ValueError("Query cannot be empty")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"Limit must be between 1 and {MAX_LIMIT}")


def check_plan(spark: SparkSession, sql: str) -> None:
    """Parse only, and refuse anything with a command in it."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kinds = [
        spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
        for name in ("Command", "ParsedStatement")
    ]
    if any(kind.isInstance(plan) for kind in kinds):
        raise ValueError("Only queries are allowed")


def adhoc_sql(spark: SparkSession, sql: str, limit: int = 1000, **tables: DataFrame) -> DataFrame:
    """Run a query after the checks; ``{name}`` in it stands for a given frame.

    Beside the word list, the parsed statement must be a query: whatever Spark
    parses to a command (``MERGE``, ``LOAD DATA``, ``ADD JAR``, ``SET``, ``CALL``
    and the like) is refused before it can run.
    """
    check_query(sql, limit)
    check_plan(spark, re.sub(r"\{(\w+)\}", r"\1", sql))
    return spark.sql(sql, **tables).limit(limit)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered frame."""
    return df.orderBy(*order).offset(offset).limit(limit)
