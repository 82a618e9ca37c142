"""What a look at the file system changes: calibration of manifests, targeted scans, merged results.

Paths meet in equi-joins on keys and exploded ancestors, never by comparing prefixes row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .changes import collapsed, excluded, longest_roots, under, with_ancestors, without_hidden


def calibrated(manifest: DataFrame, probed: DataFrame) -> DataFrame:
    """path_key, status of known and found directories.

    manifest: path_key, modified_ms; probed: path_key, kind, modified_ms, readable. Known
    ones are unchanged, changed (to be listed again), missing (gone, or no directory any
    more) or failed (unreadable: what is known of them stays); unknown directories are new.
    """
    known = manifest.groupBy("path_key").agg(F.first("modified_ms").alias("old_ms"))
    both = known.withColumn("known", F.lit(True)).join(probed, "path_key", "full")
    is_dir, is_known = F.col("kind") == "directory", F.coalesce("known", F.lit(False))
    status = (
        F.when(is_known & ~F.coalesce("readable", F.lit(True)), "failed")
        .when(is_known & F.coalesce(~is_dir, F.lit(True)), "missing")
        .when(is_known & F.col("modified_ms").eqNullSafe(F.col("old_ms")), "unchanged")
        .when(is_known, "changed")
        .when(is_dir, "new")
    )
    return both.select("path_key", status.alias("status")).where("status is not null")


def changed_children(known: DataFrame, found: DataFrame, calibration: DataFrame) -> DataFrame:
    """path_key, change of the direct children of changed directories: files new, touched or gone."""
    changed = calibration.where("status = 'changed'").select(F.col("path_key").alias("parent_key"))
    columns = ["path_key", "kind", "modified_ms", "size_bytes"]
    inside = lambda rows: rows.join(changed, "parent_key", "left_semi").where("kind != 'directory'").select(*columns)
    old = inside(known).select("path_key", F.struct("modified_ms", "size_bytes").alias("old"))
    new = inside(found).select("path_key", F.struct("modified_ms", "size_bytes").alias("new"))
    change = F.when(F.col("new").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "upsert")
    return old.join(new, "path_key", "full").select("path_key", change.alias("change")).where("change is not null")


def lost_scopes(calibration: DataFrame) -> DataFrame:
    """The topmost of the missing directories."""
    return collapsed(calibration.where("status = 'missing'").select("path_key"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """path_key, op of two scan results (path_key, op), the second one later.

    Removals of both count, without those below another; earlier upserts at or below one
    vanish; a later upsert takes back the removals at and above it.
    """
    removals = collapsed(first.where("op = 'remove'").unionByName(second.where("op = 'remove'")).select("path_key").distinct())
    early = under(first.where("op = 'upsert'").select("path_key"), removals, "left_anti")
    late = second.where("op = 'upsert'").select("path_key").distinct()
    taken_back = with_ancestors(late).select(F.col("above").alias("path_key")).distinct()
    removals = removals.join(taken_back, "path_key", "left_anti")
    upserts = early.unionByName(late).distinct()
    return upserts.withColumn("op", F.lit("upsert")).unionByName(removals.withColumn("op", F.lit("remove")))


def manifest_with_tail(manifest: DataFrame, journal: DataFrame, committed: DataFrame) -> DataFrame:
    """manifest (path_key, parent_key, root, modified_ms) after the journal that was committed meanwhile.

    A removal drops rows at and below it that are older; an upsert of a directory, or of a
    key in the committed manifest, puts its row; committed rows at or above a touched key win.
    """
    columns = ["path_key", "parent_key", "root", "modified_ms"]
    removals = journal.where("op = 'remove'").groupBy(F.col("path_key").alias("above")).agg(F.max("generation").alias("gone"))
    last = journal.where("op = 'upsert'").groupBy("path_key").agg(F.max_by(F.struct("kind", "parent_key", "root", "modified_ms"), "generation").alias("e"), F.max("generation").alias("generation"))
    known = committed.select("path_key", F.struct(*columns[1:]).alias("c"))
    put = last.join(known, "path_key", "left").where("c is not null or e.kind = 'directory'").select("path_key", "generation", F.coalesce("c", F.struct("e.parent_key", "e.root", "e.modified_ms")).alias("row"))
    base = manifest.select("path_key", F.lit(0).cast("long").alias("generation"), F.struct(*columns[1:]).alias("row")).join(put, "path_key", "left_anti")
    rows = base.unionByName(put)
    rows = without_hidden(rows, removals.select("above", F.col("gone").alias("here"), F.col("gone").alias("below"))).select("path_key", "row.*")
    touched = with_ancestors(journal.select("path_key").distinct()).select(F.col("above").alias("path_key")).distinct()
    wins = committed.select(*columns).join(touched, "path_key", "left_semi")
    return rows.join(wins, "path_key", "left_anti").select(*columns).unionByName(wins)


def updated_in_place(entries: DataFrame, affected: DataFrame, changed: DataFrame) -> DataFrame:
    """entries without what is at or below the affected keys, with the changed rows, once each."""
    kept = under(entries, affected, "left_anti").join(changed.select("path_key"), "path_key", "left_anti")
    return kept.select(*entries.columns).unionByName(changed.select(*entries.columns).dropDuplicates(["path_key"]))


def changed_paths(found: DataFrame, roots: DataFrame, root_of_rules: str, names: tuple[str, ...], patterns: tuple[str, ...] = ()) -> DataFrame:
    """path_key, root of found paths (path_key) to upsert: those in a configured root and not excluded."""
    placed = longest_roots(found.select("path_key").distinct(), roots).where("root is not null")
    return placed.join(excluded(placed, root_of_rules, names, patterns).select("path_key"), "path_key", "left_anti")


def removed_paths(events: DataFrame, roots: DataFrame, root_of_rules: str, names: tuple[str, ...], patterns: tuple[str, ...] = ()) -> DataFrame:
    """path_key of removals inside the roots that are not excluded; the file system is not asked."""
    return changed_paths(events, roots, root_of_rules, names, patterns).select("path_key")


def batch_changes(folded: DataFrame, found: DataFrame, roots: DataFrame, root_of_rules: str, names: tuple[str, ...]) -> DataFrame:
    """path_key, op of a batch of folded events (path_key, action), renames among them: removals, then what was found of the changes."""
    gone = removed_paths(folded.where("action = 'remove'"), roots, root_of_rules, names).withColumn("op", F.lit("remove"))
    there = folded.where("action = 'change'").join(found.select("path_key"), "path_key", "left_semi")
    return gone.unionByName(changed_paths(there, roots, root_of_rules, names).select("path_key", F.lit("upsert").alias("op")))


def accepted(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events (path, to_path) of which any path is inside a root."""
    keyed = events.withColumn("e", F.monotonically_increasing_id())
    any_path = keyed.select("e", F.explode(F.array_distinct(F.array_compact(F.array("path", "to_path")))).alias("p")).select("e", F.explode(P.ancestors(P.path_key(F.col("p")))).alias("path_key"))
    return keyed.join(any_path.join(roots.select("path_key").distinct(), "path_key", "left_semi").select("e").distinct(), "e", "left_semi").drop("e")


def publishable(states: DataFrame, entries: DataFrame, generation: Column) -> DataFrame:
    """Content states whose entry is still the one that was read: same generation, path, kind, root, time and size."""
    same = ["path_key", "kind", "root"]
    now = entries.select(*same, F.struct("modified_ms", "size_bytes").alias("now"))
    return states.where(F.col("generation") == generation).join(now, same).where(F.struct("modified_ms", "size_bytes").eqNullSafe(F.col("now"))).drop("now")
