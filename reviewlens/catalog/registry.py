"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlens.scale import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name, with checking SQL if any."""

    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            CHECKS[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are about to be worked on."""
    return spread(table(spark, sf_dir, name))


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
