"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, compression: str = "snappy", level: int = 3) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cuts the lineage and outlives executors. level: that of zstd."""
    return Scratch(df.sparkSession).written(df, name, compression, level)


class Scratch:
    """Intermediate tables of an operator, deleted once nothing will read them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str, compression: str = "snappy", level: int = 3) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("parquet.compression.codec.zstd.level", level).parquet(path, compression=compression)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes all tables written so far."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths = []


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles and broadcasts of steps that are done, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def picked(docs: DataFrame, *names: str) -> DataFrame:
    """These columns alone, whatever the others are called."""
    return aside(docs, *names)[0].select(*names)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but these under names that no step uses, and what gives the columns of docs back."""
    own = [c if c in names else f"__aside{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*own), lambda rows: rows.select(*own).toDF(*docs.columns)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with ``rank``, from 0 in the order of its columns; no task sees more than its range of them."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(pa.table({"part": pa.array([x for x, _ in offsets], pa.int64()), "before": pa.array([x for _, x in offsets], pa.int64())}))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at") - F.shiftleft("part", 33)).drop("part", "at", "before")


def count_partitions(spark: SparkSession, size: int, each: int, least: int = 1) -> int:
    """Partitions so that each holds about ``each`` of ``size``."""
    return max(least, -(-int(size) // each))
