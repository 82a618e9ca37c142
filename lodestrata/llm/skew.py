"""Joins on keys of which one may hold a third of all rows.

The most frequent keys, a bounded number of them, are told to all tasks. Their rows are
dealt to several tasks by a hash of another column, and the other table's row of such a
key goes to each of them. A key that is not among them holds less than one in HOT_KEYS of
all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are dealt at most.
HOT_KEYS = 1 << 16
#: Tasks that a key is dealt to at most.
PARTS = 1 << 12
#: Rows of a key that one task takes.
EACH = 1000


@dataclass
class Hot:
    """Hot keys and in how many parts each is dealt; None where no key is hot."""

    keys: list[str]
    parts: DataFrame | None

    def dealt(self, rows: DataFrame, by: str) -> DataFrame:
        """rows with ``part``, by a hash of column ``by``; 0 for keys that are not hot."""
        if self.parts is None:
            return rows.withColumn("part", F.lit(0).cast("long"))
        return rows.join(F.broadcast(self.parts), self.keys, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("long")).drop("parts")

    def spread(self, table: DataFrame) -> DataFrame:
        """table with a row for each part of its key."""
        if self.parts is None:
            return table.withColumn("part", F.lit(0).cast("long"))
        return table.join(F.broadcast(self.parts), self.keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def joined(self, rows: DataFrame, table: DataFrame, by: str, how: str = "inner") -> DataFrame:
        """rows with the columns of ``table`` (one row for each of the keys, which are not null)."""
        if self.parts is None:
            return rows.join(table, self.keys, how)
        # a hash table of several keys takes a whole memory page on every executor, however small it is
        return self.dealt(rows, by).join(self.spread(table).hint("merge"), [*self.keys, "part"], how).drop("part")


def hot(rows: DataFrame, keys: list[str], each: int | None = None) -> Hot:
    """The hot keys of rows, the most frequent HOT_KEYS at most; rows are read once more: a written table, or a cheap view of one."""
    each = each or EACH
    counts = rows.groupBy(*keys).agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > each)
    found = counts.orderBy(F.desc("hot_rows"), *keys).limit(HOT_KEYS).select(*keys, F.least(F.ceil(F.col("hot_rows") / each), F.lit(PARTS)).cast("long").alias("parts"))
    some = found.toArrow()
    # from Arrow, for a list of rows would take Python workers of another kind, which stay beside the operators'
    return Hot(keys, rows.sparkSession.createDataFrame(some) if some.num_rows else None)
