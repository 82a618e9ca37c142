"""Where queries and their SQL twins are kept, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark, sf):
    return entries.of_parts(table(spark, sf, "part"))


def docs(spark, sf):
    return entries.of_documents(table(spark, sf, "documents"))


def lines(spark, sf):
    return entries.of_lineitems(table(spark, sf, "lineitem"))
