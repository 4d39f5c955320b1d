"""Named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone import queries_retrieval, queries_text  # noqa: F401  (the first registers into the second's tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(queries_text.Q)


def oracle_sql() -> dict[str, str]:
    return dict(queries_text.SQL)
