"""The registered queries, and the SQL that DuckDB compares them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semql.plans import relational, semantic

FLAGSHIP = "hybrid_join"
_ALL = semantic.FOUND | relational.FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
