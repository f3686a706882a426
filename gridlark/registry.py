"""Registered queries: name -> (function of a session and a table folder), with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(v)``, where ``v`` gives the derived views; ``sql`` may use the views by name."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = fixtures.with_views(sql)
        return f

    return add
