"""Queries by inventory id, each with the DuckDB SQL that must give the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*ids: str, sql: str | None = None):
    """Register a function under one or more ids; several ids share a plan where one plan shows them all."""

    def add(f):
        for i in ids:
            QUERIES[i] = f
            if sql is not None:
                ORACLE_SQL[i] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from crossgauge.plans import q_corpus, q_io, q_joins, q_relational, q_stats, q_text  # noqa: F401
