"""All queries of the engine and the SQL that states what each one returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``; without SQL it is compared in the tests alone."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _load() -> None:
    from . import experiments, measures, media  # noqa: F401  registers their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of all pairs of clusterings, from vectors to scores."""
    return queries()["mi"](spark, sf_dir)
