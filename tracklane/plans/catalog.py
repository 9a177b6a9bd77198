"""Registry of the engine's named queries and their DuckDB counterparts."""

from __future__ import annotations

from tracklane.plans import context_queries, label_queries, model_queries, profile_queries, rel_queries, report_queries, source_queries, stat_queries, stream_queries, table_queries, track_queries

MODULES = [rel_queries, stat_queries, table_queries, track_queries, model_queries, report_queries, profile_queries, stream_queries, context_queries, label_queries, source_queries]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
