"""Directory trees as Spark sources.

``spark.read.format("file_tree").option("path", ...)`` walks a tree: the driver looks at
its top until there are enough directories to deal out, tasks walk these and yield Arrow
batches, so nothing is listed as a whole. ``scan_by_levels`` lists one level after the
other and keeps every level, so that it goes on where it stopped. What cannot be read is
a row with its failure. Contents are read with Spark's own binaryFile.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.versions import checkpointed

SCHEMA = "path string, kind string, modified_ms long, size_bytes long, failure string"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("modified_ms", pa.int64()), ("size_bytes", pa.int64()), ("failure", pa.string())])
BATCH = 2048
#: Directories that the driver looks for before it deals them out.
TOP = 64


def _row(path: str) -> tuple:
    """One path's row; a link counts as a file."""
    stat = os.lstat(path)
    is_dir = os.path.isdir(path) and not os.path.islink(path)
    return path, "directory" if is_dir else None, stat.st_mtime_ns // 1_000_000, None if is_dir else stat.st_size, None


def _children(path: str) -> tuple[list[tuple], list[str]]:
    """Rows of what a directory holds, and which of them are directories; a failure is a row."""
    rows: list[tuple] = []
    try:
        with os.scandir(path) as found:
            names = sorted(e.path for e in found)
    except OSError as error:
        return [(path, "directory", None, None, str(error))], []
    for name in names:
        try:
            rows.append(_row(name))
        except OSError as error:
            rows.append((name, None, None, None, str(error)))
    return rows, [r[0] for r in rows if r[1] == "directory"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class Part(InputPartition):
    def __init__(self, rows: list[tuple], directory: str | None):
        self.rows, self.directory = rows, directory


class TreeReader(DataSourceReader):
    def __init__(self, root: str, target: str | None):
        self.root, self.target = root.rstrip("/") or "/", target or root
        if os.path.commonpath([self.root, self.target]) != self.root:
            raise ValueError(f"{self.target} is outside {self.root}")
        os.lstat(self.root)  # an unreadable root is an error

    def partitions(self) -> list[Part]:
        if not os.path.isdir(self.target):
            return [Part([_row(self.target)], None)]
        rows, todo = ([] if self.target == self.root else [_row(self.target)]), [self.target]
        while todo and len(todo) < TOP and len(rows) < BATCH:
            found, below = _children(todo.pop(0))
            rows += found
            todo += below
        return [Part(rows, None), *(Part([], d) for d in todo)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, todo = list(partition.rows), [partition.directory] if partition.directory else []
        while todo or rows:
            if not todo or len(rows) >= BATCH:
                for a in range(0, len(rows), BATCH):
                    yield _batch(rows[a : a + BATCH])
                rows = []
            if todo:
                found, below = _children(todo.pop())
                rows += found
                todo += below


class TreeSource(DataSource):
    """Files and directories below a local or mounted path, or below ``target`` inside it."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("target"))


def read_tree(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("file_tree").option("path", path)
    return (reader.option("target", target) if target else reader).load()


def listed(directories: DataFrame) -> DataFrame:
    """root, directory_key, ok, children, rows of each of the directories (root, directory_key); tasks list them."""
    item = pa.struct(list(_ARROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_children(d) for d in batch.column("directory_key").to_pylist()]
            ok = [not (len(rows) == 1 and rows[0][0] == d and rows[0][4]) for d, (rows, _) in zip(batch.column("directory_key").to_pylist(), found)]
            rows = pa.array([[dict(zip(_ARROW.names, r)) for r in rows] for rows, _ in found], pa.list_(item))
            children = pa.array([below for _, below in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("directory_key"), pa.array(ok, pa.bool_()), children, rows], names=["root", "directory_key", "ok", "children", "rows"])

    schema = f"root string, directory_key string, ok boolean, children array<string>, rows array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
    return directories.select("root", "directory_key").mapInArrow(run, schema)


def scan_by_levels(spark: SparkSession, root: str, place: str, levels: int | None = None) -> DataFrame:
    """The rows of a tree, scanned level by level into folders below ``place``; a scan that stopped goes on after its last level.

    A level's folder counts once its staging table is there; ``levels`` stops a scan early.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda k: files.exists(path(f"{place}/staging-{k}/_SUCCESS"))
    k = 0
    if not done(0):
        spark.createDataFrame([(root, root, "pending")], "root string, directory_key string, state string").write.mode("overwrite").parquet(f"{place}/staging-0")
    while done(k + 1):
        k += 1
    while levels is None or k < levels:
        staging = spark.read.parquet(f"{place}/staging-{k}")
        pending = staging.where("state = 'pending'")
        if pending.isEmpty():
            break
        listed(pending.repartition("directory_key")).write.mode("overwrite").parquet(f"{place}/listed-{k}")
        checkpointed(staging, spark.read.parquet(f"{place}/listed-{k}")).write.mode("overwrite").parquet(f"{place}/staging-{k + 1}")
        k += 1
    return spark.read.parquet(*(f"{place}/listed-{j}" for j in range(k))).select(F.explode("rows").alias("r")).select("r.*")


def read_contents(spark: SparkSession, path: str, most: int) -> DataFrame:
    """path, size_bytes, state, content of files: binary and too large ones have no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = F.col("length") <= most
    text = F.try_validate_utf8(F.col("content").cast("string"))
    binary = F.col("content").cast("string").contains("\0") | text.isNull()
    state = F.when(~small, "skipped_too_large").when(binary, "skipped_binary").otherwise("indexed")
    return files.select("path", F.col("length").alias("size_bytes"), state.alias("state"), F.when(state == "indexed", text).alias("content"))


def ignore_files(rows: DataFrame) -> DataFrame:
    """dir_key, source, line, text of the ignore files among a tree's rows (path), for ``changes.ignore_rules``."""
    path = F.col("path")
    source = F.when(path.endswith("/.ignore"), "ignore").when(path.endswith("/.gitignore"), "gitignore").when(path.endswith("/.git/info/exclude"), "exclude")
    files = rows.select(F.regexp_replace(path, r"/(\.git/info/)?[^/]*$", "").alias("dir_key"), source.alias("source"), "path").where("source is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dir_key, source, path in zip(*(c.to_pylist() for c in batch.columns)):
                with open(path, encoding="utf-8", errors="replace") as file:
                    lines = file.read().splitlines()
                yield pa.RecordBatch.from_pydict({"dir_key": [dir_key] * len(lines), "source": [source] * len(lines), "line": list(range(1, len(lines) + 1)), "text": lines}, schema=pa.schema([("dir_key", pa.string()), ("source", pa.string()), ("line", pa.int32()), ("text", pa.string())]))

    return files.mapInArrow(run, "dir_key string, source string, line int, text string")
