"""Every registered query of the library and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.plans import graph_queries, more_queries, more_sql, rule_queries, source_queries, text_queries

_MODULES = (text_queries, graph_queries, rule_queries, source_queries, more_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()} | more_sql.SQL
