"""The registered queries, by name, and their SQL for an independent engine."""

from __future__ import annotations

from . import file_queries, geometry_queries, pair_queries, signal_queries

_PARTS = (signal_queries, pair_queries, geometry_queries, file_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
