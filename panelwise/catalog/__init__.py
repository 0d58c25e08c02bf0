"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator,
with the equivalent DuckDB SQL where one exists."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import cleaning, features, io, learning, models, quality, reports, scaling, scoring, streams  # noqa: F401
