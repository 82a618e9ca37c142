"""Writing and publishing versions of a catalog: staging, states, activation, rollback, clean-up.

batches: id, root, status, completed_at_ms; metadata: batch_id, config_fingerprint,
baseline_generation; generations: id, root, state, config_fingerprint, updated_at_ms;
states are building, prepared, active and obsolete.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .rows import first_of

# ---------------------------------------------------------------- tables


def write_batch(entries: DataFrame, place: str, batch_id: int, at_ms: int) -> None:
    """The rows of a batch, a folder for each root, and then the row that makes it count."""
    rows = f"{place}/entries/batch_id={batch_id}"
    entries.write.mode("overwrite").partitionBy("root").parquet(rows)
    done = entries.sparkSession.read.parquet(rows).agg(F.count("*").alias("n")).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(at_ms).cast("long").alias("completed_at_ms"), "n")
    done.coalesce(1).write.mode("append").parquet(f"{place}/batches")


def read_batches(spark: SparkSession, place: str) -> DataFrame:
    """The rows of all batches that were completed, with batch_id."""
    done = spark.read.parquet(f"{place}/batches").select("batch_id").distinct()
    return spark.read.parquet(f"{place}/entries").withColumn("batch_id", F.col("batch_id").cast("long")).join(F.broadcast(done), "batch_id", "left_semi")


def new_place(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share; a local one where that is not set, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """table with rows of the same keys replaced; of several rows of a key the last in ``order`` counts."""
    if order is not None:
        rows = first_of(rows, keys, [order.desc()])
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def replaced_roots(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """manifest with all rows of the roots of ``rows`` replaced by these, one for each key."""
    return manifest.join(rows.select("root").distinct(), "root", "left_anti").select(*manifest.columns).unionByName(rows.select(*manifest.columns).dropDuplicates(["path_key"]))


def with_content_states(entries: DataFrame, states: DataFrame) -> DataFrame:
    """entries with the content state that (path_key, state) tells."""
    told = states.select("path_key", F.col("state").alias("told"))
    return entries.join(told, "path_key", "left").withColumn("content_index_state", F.coalesce("told", "content_index_state")).select(*entries.columns)


# ---------------------------------------------------------------- joins of the catalog's tables


def staging_batches(staging: DataFrame, batches: DataFrame, generations: DataFrame) -> DataFrame:
    """batch_id, root, status, state of batches that are being staged."""
    return staging.select("batch_id").distinct().join(batches.select(F.col("id").alias("batch_id"), "root", "status"), "batch_id").join(generations.select(F.col("id").alias("batch_id"), "state"), "batch_id")


def active_batches(runtime: DataFrame, batches: DataFrame, metadata: DataFrame) -> DataFrame:
    """root, id, completed_at_ms, config_fingerprint of the batch that each root's runtime row (root, active_id) names."""
    done = batches.where("status = 'completed'").select(F.col("id").alias("active_id"), "completed_at_ms")
    return runtime.join(done, "active_id").join(metadata.select(F.col("batch_id").alias("active_id"), "config_fingerprint"), "active_id").select("root", F.col("active_id").alias("id"), "completed_at_ms", "config_fingerprint")


def generation_records(generations: DataFrame, batches: DataFrame) -> DataFrame:
    """id, state, status, completed_at_ms of each generation and its batch."""
    return generations.select("id", "state").join(batches.select("id", "status", "completed_at_ms"), "id")


def backfilled(batches: DataFrame, metadata: DataFrame, staging: DataFrame, active: DataFrame) -> DataFrame:
    """id, root, config_fingerprint, state, updated_at_ms for batches from before there were generations.

    The active one is what ``active`` (root, active_id) says, else the root's newest
    completed; of those still being built the newest goes on, the others are obsolete.
    """
    newest = batches.where("status = 'completed'").groupBy("root").agg(F.max_by("id", F.struct("completed_at_ms", "id")).alias("newest_id"))
    rows = batches.join(metadata.select(F.col("batch_id").alias("id"), F.col("config_fingerprint").alias("known")), "id", "left")
    rows = rows.join(staging.select(F.col("batch_id").alias("id"), F.lit(True).alias("staged")).distinct(), "id", "left")
    rows = rows.join(newest, "root", "left").join(active, "root", "left")
    state = F.when(F.col("id") == F.coalesce("active_id", "newest_id"), "active").when((F.col("status") == "building") & F.col("staged"), "building").otherwise("obsolete")
    rows = rows.select("id", "root", F.coalesce("known", F.lit("")).alias("config_fingerprint"), state.alias("state"), F.col("completed_at_ms").alias("updated_at_ms"))
    last = rows.where("state = 'building'").groupBy("root").agg(F.max_by("id", F.struct("updated_at_ms", "id")).alias("last_id"))
    goes_on = (F.col("state") != "building") | (F.col("id") == F.col("last_id"))
    return rows.join(last, "root", "left").withColumn("state", F.when(goes_on, F.col("state")).otherwise("obsolete")).drop("last_id")


def entries_of_obsolete(entries: DataFrame, generations: DataFrame) -> DataFrame:
    """Entries (batch_id) of obsolete generations."""
    return entries.join(generations.where("state = 'obsolete'").select(F.col("id").alias("batch_id")), "batch_id", "left_semi")


def beyond_newest(rows: DataFrame, by: str, order: list[Column], n: int, retained: DataFrame | None = None) -> DataFrame:
    """Rows (id) that are neither among the newest n of their group nor among the retained ids."""
    older = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") > n).drop("place")
    return older if retained is None else older.join(retained.select("id"), "id", "left_anti")


# ---------------------------------------------------------------- states


def activated(generations: DataFrame, chosen: DataFrame) -> DataFrame:
    """generations after publishing the chosen (root, id, config_fingerprint): only a prepared one of the same configuration."""
    same = chosen.select("root", "id", "config_fingerprint", F.lit(True).alias("chosen"))
    ready = generations.where("state = 'prepared'").join(same, ["root", "id", "config_fingerprint"], "left_semi").select("root", F.col("id").alias("new_id"))
    state = F.when(F.col("id") == F.col("new_id"), "active").when(F.col("new_id").isNotNull() & (F.col("state") == "active"), "obsolete").otherwise(F.col("state"))
    return generations.join(ready, "root", "left").withColumn("state", state).select(*generations.columns)


def restored(generations: DataFrame, failed: DataFrame) -> DataFrame:
    """generations after a failed revision: per root of ``failed`` (root, baseline_id) the baseline is active again."""
    state = F.when(F.col("id") == F.col("baseline_id"), "active").when(F.col("baseline_id").isNotNull() & (F.col("state") == "active"), "obsolete").otherwise(F.col("state"))
    return generations.join(failed.select("root", "baseline_id"), "root", "left").withColumn("state", state).select(*generations.columns)


def state_faults(generations: DataFrame) -> DataFrame:
    """root, fault: more than one active, or more than one pending generation."""
    counts = generations.groupBy("root").agg(F.count(F.when(F.col("state") == "active", 1)).alias("active"), F.count(F.when(F.col("state").isin("building", "prepared"), 1)).alias("pending"))
    return counts.select("root", F.explode(F.array_compact(F.array(F.when(F.col("active") > 1, "several_active"), F.when(F.col("pending") > 1, "several_pending")))).alias("fault"))


def runtime_faults(runtime: DataFrame) -> DataFrame:
    """Rows whose baseline generation is ahead of the last one."""
    return runtime.where("baseline_generation > last_generation")


def diagnostics(generations: DataFrame, entries: DataFrame) -> DataFrame:
    """root, generations, active_id, pending_id (the newest) and entries of the active one."""
    size = entries.groupBy(F.col("batch_id").alias("active_id")).agg(F.count("*").alias("n_entries"))
    pending = F.when(F.col("state").isin("building", "prepared"), F.struct("updated_at_ms", "id"))
    per_root = generations.groupBy("root").agg(F.count("*").alias("n_generations"), F.max(F.when(F.col("state") == "active", F.col("id"))).alias("active_id"), F.max(pending)["id"].alias("pending_id"))
    return per_root.join(size, "active_id", "left").select("root", "n_generations", "active_id", "pending_id", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def needs_refresh(entries: DataFrame) -> DataFrame:
    """root, needs_refresh: whether any row lacks what later versions record."""
    return entries.groupBy("root").agg(F.coalesce(F.bool_or(F.col("modified_ms").isNull() | F.col("size_bytes").isNull()), F.lit(False)).alias("needs_refresh"))


# ---------------------------------------------------------------- manifests and staging


def prepared_manifest(entries: DataFrame) -> DataFrame:
    """path_key, parent_key, root, modified_ms of a batch's directories and applications; empty parents are null."""
    return entries.where("kind in ('directory', 'application')").select("path_key", F.nullif("parent_key", F.lit("")).alias("parent_key"), "root", "modified_ms")


def manifest_change_faults(manifest: DataFrame, upserts: DataFrame, removals: DataFrame) -> DataFrame:
    """path_key, fault: removals outside every known root, and upserts that would move a row to another root."""
    roots = manifest.select(F.col("root").alias("above")).distinct()
    inside = removals.select("path_key", F.explode(P.ancestors(F.col("path_key"))).alias("above")).join(roots, "above").select("path_key").distinct()
    outside = removals.join(inside, "path_key", "left_anti").select("path_key", F.lit("outside_roots").alias("fault"))
    moved = upserts.select("path_key", F.col("root").alias("new_root")).join(manifest.select("path_key", "root"), "path_key").where("root != new_root")
    return outside.unionByName(moved.select("path_key", F.lit("root_changed").alias("fault")))


def open_directories(staging: DataFrame) -> DataFrame:
    """root, directory_key of directories still to be read, the shallow ones first."""
    return staging.where("state = 'pending'").select("root", "directory_key").orderBy(F.length("directory_key"), "directory_key", "root")


def checkpointed(staging: DataFrame, read: DataFrame) -> DataFrame:
    """staging (root, directory_key, state) after directories were read: ``read`` has (root, directory_key, ok, children).

    A read directory is completed, its children are pending; one that failed stays failed
    and emits no children; directories known already keep their state.
    """
    keys = ["root", "directory_key"]
    done = read.select(*keys, F.when(F.col("ok"), "completed").otherwise("failed").alias("new"))
    kept = staging.join(done, keys, "left").select(*keys, F.coalesce("new", "state").alias("state"))
    fresh = read.where("ok").select("root", F.explode("children").alias("directory_key"), F.lit("pending").alias("state")).distinct()
    return kept.unionByName(fresh.join(staging, keys, "left_anti"))


def staging_state(staging: DataFrame) -> DataFrame:
    """root, state: completed, degraded (some directory failed) or building."""
    state = F.col("state")
    found = F.when(F.bool_or(state == "pending"), "building").when(F.bool_or(state == "failed"), "degraded").otherwise("completed")
    return staging.groupBy("root").agg(found.alias("state"))
