"""From batches of events to committed changes: caps, dirty roots, and when to compact or refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Paths of a batch, and rows and bytes of all changes, from which on a full pass is due.
BATCH_PATHS, DELTA_ROWS, DELTA_BYTES = 8192, 50_000, 64 << 20


def capped(events: DataFrame, most: int = BATCH_PATHS) -> DataFrame:
    """batch, path, dirty: the distinct paths of each batch; a batch of more paths than ``most`` is one row that marks all roots dirty."""
    paths = events.select("batch", "path").distinct()
    sizes = paths.groupBy("batch").agg((F.count("*") > most).alias("dirty"))
    over = sizes.where("dirty").select("batch", F.lit(None).cast("string").alias("path"), "dirty")
    return paths.join(sizes.where("not dirty"), "batch").select("batch", "path", "dirty").unionByName(over)


def delta_state(changes: DataFrame, by: list[str], most_rows: int = DELTA_ROWS, most_bytes: int = DELTA_BYTES) -> DataFrame:
    """by, n_rows, n_bytes, compact: whether the changes since the baseline have reached a limit."""
    sums = changes.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce("bytes", F.lit(0))).alias("n_bytes"))
    return sums.withColumn("compact", (F.col("n_rows") >= most_rows) | (F.col("n_bytes") >= most_bytes))


def dirty_roots(roots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """root, dirty, code: a root's state is that of its last outcome (root, seq, code); ``calibrated`` cleans it."""
    last = outcomes.groupBy("root").agg(F.max_by("code", "seq").alias("code"))
    code = F.when(F.col("code") != "calibrated", F.col("code"))
    return roots.join(last, "root", "left").select("root", code.isNotNull().alias("dirty"), code.alias("code"))


def refresh_decision(semantics_changed: Column, manifest_ready: Column, dirty: Column) -> Column:
    """full:reason, or calibrate."""
    return F.when(semantics_changed, "full:config_changed").when(~manifest_ready, "full:manifest_unavailable").when(dirty > 0, "full:dirty_roots").otherwise("calibrate")


def request_decision(active: Column) -> Column:
    """start, or absorbed by the refresh that is running."""
    return F.when(active, "absorbed").otherwise("start")


def committing(events: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``commit(batch, generation)`` for every micro-batch; a batch that comes again has the same generation."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            commit(batch, epoch + 1)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
