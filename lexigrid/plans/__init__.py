"""Registered queries: plans over the operators, with their DuckDB counterparts."""

from __future__ import annotations

from . import gold_queries, lookup_queries, record_queries, search_queries, workflow_queries

TABLE = search_queries.SEARCH | record_queries.RECORDS | gold_queries.GOLD | workflow_queries.WORKFLOWS | lookup_queries.LOOKUPS
flagship = search_queries.search_flagship


def queries():
    return {name: run for name, (run, _) in TABLE.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in TABLE.items() if sql}
