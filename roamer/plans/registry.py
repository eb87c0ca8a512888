"""Queries by name, with their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.operators import segment
from roamer.operators.segment import TRIPS_SQL
from roamer.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GAP = 28800
WITH_HISTORY = "WITH RECURSIVE " + tables.HISTORY_SQL
WITH_TRIPS = WITH_HISTORY + ", " + TRIPS_SQL


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.history_from_events(spark, sf_dir)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.routed(history(spark, sf_dir))[0]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.by_gap(positions(spark, sf_dir), GAP)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.summarised(points(spark, sf_dir))


def r(column: str, digits: int = 6, name: str | None = None):
    return F.round(column, digits).alias(name or column)


def quick(column: str, digits: int = 6, name: str | None = None):
    """``r`` of a double column for very many rows: the same values, by decimals only where a half is near."""
    x = F.col(column) * 10.0**digits
    safe = (F.abs(x - F.rint(x)) < 0.499) & (F.abs(x) < 2.0**40)
    return F.when(safe, F.rint(x) / 10.0**digits + 0.0).otherwise(F.round(column, digits)).alias(name or column)
