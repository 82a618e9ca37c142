"""Versions of a catalog: which is active, what can be resumed or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key
from .rows import first_of


def latest(batches: DataFrame) -> DataFrame:
    """Per root the newest completed batch: root, id, completed_at_ms."""
    done = batches.where("status = 'completed'")
    return done.groupBy("root").agg(F.max(F.struct("completed_at_ms", "id")).alias("b")).select("root", "b.id", "b.completed_at_ms")


def pending(generations: DataFrame) -> DataFrame:
    """Per root the generation to resume: a prepared one before one that is being built, then the newest."""
    open_ = generations.where(F.col("state").isin("prepared", "building"))
    order = [F.when(F.col("state") == "prepared", 0).otherwise(1), F.desc("updated_at_ms"), F.desc("id")]
    return first_of(open_, ["root"], order).select("root", "id", "state")


def resume_decision(generations: DataFrame, roots: DataFrame) -> DataFrame:
    """root, decision: publish a prepared generation, continue a building one, nothing if one is active, else create."""
    active = generations.where("state = 'active'").select("root", F.lit(True).alias("active")).distinct()
    joined = roots.join(pending(generations), "root", "left").join(active, "root", "left")
    decision = F.when(F.col("state") == "prepared", "publish").when(F.col("state") == "building", "continue").when(F.col("active"), "idle").otherwise("create")
    return joined.select("root", decision.alias("decision"))


def collectable(generations: DataFrame) -> DataFrame:
    """Generations that are neither active nor their root's pending one."""
    return generations.where("state != 'active'").join(pending(generations).select("id"), "id", "left_anti").select("id", "root", "state")


def orphans(batches: DataFrame, staging: DataFrame) -> DataFrame:
    """Batches being built without a staging row."""
    return batches.where("status = 'building'").join(staging.select(F.col("batch_id").alias("id")), "id", "left_anti").select("id", "root")


def progress(directories: DataFrame) -> DataFrame:
    """Sums over completed directories, zero where there is none."""
    done = F.col("state") == "completed"
    return directories.groupBy("root").agg(*(F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in ("scanned", "accepted", "skipped", "failures")))


def storage_estimate(entries: DataFrame) -> DataFrame:
    """root, bytes: six times the text and 512 for each row."""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("path", "name", "parent", "extension")), F.lit(0))
    return entries.groupBy("root").agg(F.sum((6 * text + 512).cast("long")).alias("bytes"))


def usage(opened: DataFrame) -> DataFrame:
    """path, open_count, last_opened."""
    return opened.groupBy("path").agg(F.count("*").alias("open_count"), F.max("ts").alias("last_opened"))


def unique_keys(rows: DataFrame) -> DataFrame:
    """n: how many different keys the paths have."""
    return rows.select(path_key(F.col("path")).alias("path_key")).distinct().agg(F.count("*").alias("n"))


def roots(rows: DataFrame) -> DataFrame:
    """The distinct roots that are not empty."""
    return rows.select("root").where("root != ''").distinct()
