"""Small records in a folder that all writers share: written once, by whoever comes first.

A record is written under a name of its own, then given its final name in one step that
fails where that name is taken. So a reader never sees half a record, and of two writers
one is told that it came second.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import new_place


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """What is in the folder, without unfinished records."""
        if not self.fs.exists(self.at("")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if not n.startswith((".", "_")))

    def read(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def put(self, name: str, text: str) -> bool:
        """Whether the record is there now; false, and nothing written, where the name was taken."""
        self.fs.mkdirs(self.at(""))
        own = f".{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.at(own), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":  # renaming a local file replaces another, linking doesn't
                place = lambda n: self.jvm.java.io.File(self.at(n).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(place(name), place(own))
                return True
            return bool(not self.fs.exists(self.at(name)) and self.fs.rename(self.at(own), self.at(name)))
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            self.fs.delete(self.at(own), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class State:
    """A record that changes by numbered versions; a change that was made on an old version is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if re.fullmatch(r"\d+", n))

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The newest version's number and record; 0 and nothing before the first."""
        known = [version] if version else self.versions()
        return (known[-1], json.loads(self.folder.read(f"{known[-1]:020d}"))) if known else (0, {})

    def put(self, version: int, record: dict) -> bool:
        """Follows ``version``, unless another record does."""
        return self.folder.put(f"{version + 1:020d}", json.dumps(record, sort_keys=True))

    def update(self, change: Callable[[dict], dict | None], tries: int = 10) -> dict | None:
        """The new record; None where ``change`` refuses the newest one. Made again where another writer was first."""
        for _ in range(tries):
            version, record = self.read()
            new = change(dict(record))
            if new is None or self.put(version, new):
                return new
        raise TimeoutError(f"{tries} other writers were first")


def union(spark: SparkSession, places: list[str], schema) -> DataFrame:
    """The rows of all these Parquet folders, in one scan."""
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*places)


def fingerprint(spark: SparkSession, rows: DataFrame) -> str:
    """Names, sizes and times of the files below rows: what is stored for them holds as long as these."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    out = []
    for name in sorted(rows.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(out)


_stored: dict[tuple[str, str, str], str] = {}


def kept(rows: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The place of what ``build`` has stored for the files of rows, once an application."""
    spark = rows.sparkSession
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, rows))
    if key not in _stored:
        place = new_place(spark, name)
        build(place)
        _stored[key] = place
    return _stored[key]


def numbered(rows: DataFrame, order: list[str], place: str) -> DataFrame:
    """rows with ``id``, their place in the order, from 0 without gaps; they are written to ``place`` once, sorted by range."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    placed.write.parquet(place)
    placed = spark.read.schema(placed.schema).parquet(place)
    before, offsets = 0, []
    for r in sorted(placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("at")).collect()):  # a row for each partition
        offsets.append((r["__part"], before - r["at"]))
        before += r["n"]
    shift = F.broadcast(spark.createDataFrame(offsets, "__part int, __shift long"))
    return placed.join(shift, "__part").withColumn("id", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
