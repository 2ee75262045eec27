"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name`` with its SQL twin."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from tessella.session import configure

            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__, run.__module__ = name, fn.__doc__, fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
