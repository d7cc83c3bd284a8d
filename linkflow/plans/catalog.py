"""Named queries over the driver tables, each with its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is SQL
over the driver tables (views inlined as CTEs) that must give the same rows.
Queries without an oracle are checked by row count only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def sql_str(text: str) -> str:
    """A SQL string literal (quotes doubled; backslashes stay literal)."""
    return "'" + text.replace("'", "''") + "'"


def load_all() -> None:
    """Import the modules that register queries."""
    from linkflow.plans import (  # noqa: F401
        q_corpus, q_features, q_generate, q_links, q_requests, q_sources, q_streams,
    )
