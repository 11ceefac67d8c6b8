"""Registry of named queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from keelson.fixtures import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)``; ``sql`` is completed with ``views``."""

    def wrap(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, fn, with_views(sql, *views) if sql else None)
        return fn

    return wrap
