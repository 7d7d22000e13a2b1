"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from .plans import analysis_queries, display_queries, interval_queries, matrix_queries, neighbor_queries, request_queries, source_queries, stats_queries

MODULES = (matrix_queries, interval_queries, neighbor_queries, stats_queries, analysis_queries, source_queries, display_queries, request_queries)


def queries():
    return {name: pair[0] for module in MODULES for name, pair in module.QUERIES.items()}


def oracle_sql():
    return {name: pair[1] for module in MODULES for name, pair in module.QUERIES.items() if pair[1]}
