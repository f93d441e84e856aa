"""All queries of the operators."""

from __future__ import annotations

from . import graph_queries, more_queries, signal_queries, telemetry_queries, text_queries

_PARTS = (telemetry_queries.R, text_queries.R, graph_queries.R, signal_queries.R, more_queries.R)


def queries() -> dict:
    return {k: v for r in _PARTS for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _PARTS for k, v in r.sql.items()}
