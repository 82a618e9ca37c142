"""Rows of groups: the first, the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The n newest distinct keys with their last time."""
    return rows.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(n)


def recorded(history: DataFrame, rows: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """history (key, at) after rows were put into it, cut to the n newest; keys are trimmed and empty ones left out."""
    trimmed = rows.select(F.regexp_replace(key, r"^\s+|\s+$", "").alias(key), at).where(F.col(key) != "")
    return newest(history.select(key, at).unionByName(trimmed), key, at, n)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
