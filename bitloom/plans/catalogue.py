"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.plans import evaluation, language, ledgers, pages

_MODULES = (language, ledgers, evaluation, pages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each takes (spark, sf_dir) and runs over whole tables."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """For DuckDB, by the names of queries(); none where SQL cannot say it."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
