"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.checks.views import shown, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without SQL the query is checked for rows only."""

    def register(fn):
        QUERIES[name] = lambda spark, sf: shown(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return fn

    return register
