"""A journal of changes: batches, each a generation of upserts and removals, committed once.

batches: id, generation, status, digest; changes: batch_id, ordinal, op, path_key and the
entry's columns. A batch counts once its row says ``committed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

OPERATIONS = ("upsert", "remove")


def fingerprint(*columns: str) -> Column:
    """240 bits of a row: four numbers, from a text in which every value is preceded by its length."""
    marked = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    digest = F.sha2(F.concat(*marked), 256)
    return F.array(*(F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long") for k in range(4)))


def digests(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, digest: of all values of the columns, whatever the order of rows; sums are partial before the shuffle."""
    marked = rows.withColumn("f", fingerprint(*columns))
    sums = marked.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col("f")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)))
    return sums.select(*by, "n", F.concat_ws("-", *(F.col(f"s{k}").cast("string") for k in range(4))).alias("digest"))


def committed_after(batches: DataFrame, changes: DataFrame, generation: int) -> DataFrame:
    """generation and change of every committed batch after a generation; batches without changes keep a row."""
    done = batches.where((F.col("status") == "committed") & (F.col("generation") > generation)).select(F.col("id").alias("batch_id"), "generation")
    return done.join(changes, "batch_id", "left").drop("batch_id")


def faults(journal: DataFrame) -> DataFrame:
    """generation, fault: gaps in ordinals, bad operations, missing and repeated paths (as keys) of committed changes."""
    rows = journal.where("ordinal is not null").withColumn("key", P.path_key(F.col("path_key")))
    bad_op = F.col("op").isNull() | ~F.col("op").isin(*OPERATIONS)
    no_path = F.coalesce(F.col("key"), F.lit("")) == ""
    each = rows.groupBy("generation").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("k"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.max(bad_op).alias("bad_op"), F.max(no_path).alias("no_path"))
    gap = (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("k") != F.col("n"))
    found = each.select("generation", F.explode(F.array_compact(F.array(F.when(gap, "ordinal_gap"), F.when(F.col("bad_op"), "bad_operation"), F.when(F.col("no_path"), "missing_path")))).alias("fault"))
    twice = rows.where(~no_path).groupBy("generation", "key").agg(F.count("*").alias("n")).where("n > 1").select("generation", F.lit("repeated_path").alias("fault")).distinct()
    return found.unionByName(twice)


def commit_decisions(batches: DataFrame, incoming: DataFrame) -> DataFrame:
    """generation, decision for incoming batches (generation, digest): append, done already, or a conflict."""
    known = batches.select("generation", "status", F.col("digest").alias("known"))
    decision = F.when(F.col("status").isNull(), "append").when(F.col("status") != "committed", "unfinished").when(F.col("known") == F.col("digest"), "done").otherwise("conflict")
    return incoming.join(known, "generation", "left").select("generation", decision.alias("decision"))


def unique_deltas(deltas: DataFrame) -> DataFrame:
    """generation, n, conflict of deltas (generation, digest) that may have been read more than once."""
    return deltas.groupBy("generation").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("conflict"))


def missing_generations(deltas: DataFrame, after: int) -> DataFrame:
    """Generations that do not follow another one, nor ``after``, the baseline's."""
    seen = deltas.where(F.col("generation") > after).select("generation").distinct()
    return seen.where(F.col("generation") != after + 1).join(seen.select((F.col("generation") + 1).alias("generation")), "generation", "left_anti")


def recovery(spark: SparkSession, generation: int, manifest_faults: DataFrame, journal: DataFrame) -> DataFrame:
    """mode, code of how a catalog comes back: with the journal on the baseline, or the baseline alone."""
    code = F.when(manifest_faults.exists(), "manifest_invalid").when(faults(journal).exists(), "journal_invalid").when(missing_generations(journal, generation).exists(), "journal_gap")
    return spark.range(1).select(code.alias("code")).select(F.when(F.col("code").isNull(), "replayed").otherwise("baseline_only").alias("mode"), "code")


def targeted(batches: DataFrame, changes: DataFrame, keys: DataFrame, generation: int) -> DataFrame:
    """Committed changes at the keys (path_key) or any directory above them, as generation, ordinal, op, path_key."""
    above = keys.select(F.explode(P.ancestors(F.col("path_key"))).alias("path_key")).distinct()
    return committed_after(batches, changes, generation).join(above, "path_key", "left_semi").select("generation", "ordinal", "op", "path_key")


def children_at_head(baseline: DataFrame, journal: DataFrame, parent: str) -> DataFrame:
    """path_key, size_bytes of a directory's direct children after the whole journal.

    A removal of the directory, or of one above it, empties it; later upserts fill it again.
    """
    key = F.lit(parent)
    emptied = journal.where("op = 'remove'").where(P.covers(F.col("path_key"), key)).agg(F.coalesce(F.max("generation"), F.lit(-1))).scalar()
    rows = baseline.select("path_key", "size_bytes", F.lit(0).cast("long").alias("generation"), F.lit(-1).cast("long").alias("ordinal"), F.lit("upsert").alias("op"))
    rows = rows.unionByName(journal.select("path_key", "size_bytes", "generation", "ordinal", "op")).where(P.parent_key(F.col("path_key")) == key)
    last = rows.groupBy("path_key").agg(F.max_by(F.struct("op", "size_bytes", "generation"), F.struct("generation", "ordinal")).alias("last"))
    return last.where((F.col("last.op") == "upsert") & (F.col("last.generation") > emptied)).select("path_key", F.col("last.size_bytes").alias("size_bytes"))
