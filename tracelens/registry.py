"""Every registered query of the analytics operators with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cross_queries, read_queries, scan_queries

_TABLES = (scan_queries.TABLE, read_queries.TABLE, cross_queries.TABLE)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run for t in _TABLES for name, (run, _) in t.items()}
SQL: dict[str, str] = {name: text for t in _TABLES for name, (_, text) in t.items() if text}
