"""The query catalogue of the core and its SQL."""

from __future__ import annotations

from kithloom.plans import graph_queries, graph_sql, io_queries, scale

QUERIES = {**graph_queries.QUERIES, **io_queries.QUERIES, **scale.QUERIES}
ORACLE = {**graph_sql.ORACLE, **io_queries.ORACLE, **scale.ORACLE}
