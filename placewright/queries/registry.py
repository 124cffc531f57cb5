"""A decorator that registers a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a function of the named views; sql may name views, which are put before it."""

    def register(build: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(*views(spark, sf_dir, *tables))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
