"""The registered queries over the derived tables, with their oracle SQL."""

from airtrace.registry import (  # noqa: F401
    base,
    contact_queries,
    flight_queries,
    controller_queries,
    integrity_queries,
    requirement_queries,
    match_queries,
    filter_queries,
    sector_queries,
    lifecycle_queries,
    quality_queries,
    source_queries,
    streaming_queries,
)


def queries():
    return dict(base.QUERIES)


def oracles():
    return dict(base.ORACLES)
