"""All registered queries of the engine, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella import queries as registry
from tessella.queries import extensions, governance, inventory, lexical, network  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to SQL, for those that have one."""
    return dict(registry.SQL)
