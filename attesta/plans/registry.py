"""All registered queries and their checks."""

from __future__ import annotations

from . import (
    findings_queries,
    graph_queries,
    landed_queries,
    listings_queries,
    pages_queries,
    reports_queries,
    stats_queries,
    streams_queries,
)

_GROUPS = (
    findings_queries,
    listings_queries,
    reports_queries,
    graph_queries,
    stats_queries,
    pages_queries,
    streams_queries,
    landed_queries,
)


def queries() -> dict:
    return {name: query for group in _GROUPS for name, query in group.QUERIES.items()}


def checks() -> dict:
    return {name: check for group in _GROUPS for name, check in group.CHECKS.items()}
