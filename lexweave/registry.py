"""All queries of the engine and their SQL.

A query is a function (spark, sf_dir) -> DataFrame that binds operators to the
tables in ``sf_dir``; its SQL, where there is one, runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables``."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return add


def _load() -> None:
    from .plans import bind  # noqa: F401


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)
