"""Change data: events to change sets, merge-on-read views, snapshot differences.

Subtree rules never compare prefixes row by row: a key's ancestors are looked up among the
roots, in the scan where these are few, else by distinct directory: the ancestors of each
directory that holds rows are exploded once and joined on equality, and rows meet what was
found for their own directory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .rows import first_of


def normalised(events: DataFrame) -> DataFrame:
    """seq, path, action of each event (seq, op, path, to_path).

    A rename removes one path and changes another; of those seen from one side only,
    ``rename_from`` removes and ``rename_to`` changes; a rename to nowhere known calls for a rescan.
    """
    op = F.col("op")
    action = F.when(op.isin("remove", "rename_from"), "remove").when((op == "rename") & F.col("to_path").isNull(), "rescan").otherwise("change")
    both = F.array(F.struct(F.col("path").alias("path"), F.lit("remove").alias("action")), F.struct(F.col("to_path").alias("path"), F.lit("change").alias("action")))
    one = F.array(F.struct(F.col("path").alias("path"), action.alias("action")))
    steps = F.when((op == "rename") & F.col("to_path").isNotNull(), both).otherwise(one)
    return events.select("seq", F.posexplode(steps).alias("step", "e")).select("seq", "step", "e.path", "e.action")


def folded(events: DataFrame) -> DataFrame:
    """path, action: the last action of each path."""
    return normalised(events).groupBy("path").agg(F.max_by("action", F.struct("seq", "step")).alias("action"))


def with_ancestors(rows: DataFrame, key: str = "path_key") -> DataFrame:
    """A row for each of the key and its ancestors, as ``above``."""
    return rows.select("*", F.explode(P.ancestors(F.col(key))).alias("above"))


def by_directory(rows: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (path_key) with ``__dir``, the directory of each, and what ``found`` makes of (__dir, above), by __dir.

    Every row of a directory has the same ancestors: they are exploded once for each
    distinct directory, so neither the topmost key nor a large directory gathers its rows.
    """
    placed = rows.withColumn("__dir", P.directory(F.col("path_key")))
    held = with_ancestors(placed.select("__dir").where("__dir is not null").distinct(), "__dir")
    return placed.join(found(held), "__dir", "left")


def without_hidden(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (path_key, generation) without those older than what hides them: ``here`` at their key, ``below`` at a directory above it (gone: above, here, below)."""
    over = by_directory(rows, lambda held: held.join(gone.where("below is not null").select("above", "below"), "above").groupBy("__dir").agg(F.max("below").alias("__below")))
    own = gone.where("here is not null").select(F.col("above").alias("path_key"), F.col("here").alias("__here"))
    hidden = F.greatest("__below", "__here")
    return over.join(own, "path_key", "left").where(hidden.isNull() | (F.col("generation") >= hidden)).select(*rows.columns)


#: Roots that are told to the scan at most; more are joined.
TOLD_ROOTS = 1024


def under(rows: DataFrame, roots: DataFrame, how: str, strictly: bool = False, told: int = TOLD_ROOTS) -> DataFrame:
    """Rows (path_key) that are, or are not (``left_semi``, ``left_anti``), at or below one of the roots (path_key).

    A few roots are tested in the scan of the rows, which then don't move.
    """
    roots = roots.select("path_key").where("path_key is not null").distinct()
    few = [r["path_key"] for r in roots.limit(told + 1).collect()]
    if len(few) <= told:
        above = P.ancestors(F.col("path_key"))
        if strictly:
            above = F.filter(above, lambda a: a != F.col("path_key"))
        hit = F.exists(above, lambda a: a.isin(*few)) if few else F.lit(False)
        if few and not strictly:
            hit = hit | F.col("path_key").isin(*few)
        return rows.where(hit) if how == "left_semi" else rows.where(~F.coalesce(hit, F.lit(False)))
    hit = by_directory(rows, lambda held: held.join(roots.select(F.col("path_key").alias("above")), "above").groupBy("__dir").agg(F.lit(True).alias("__covered")))
    test = F.col("__covered").isNotNull()
    if not strictly:
        hit, test = hit.join(roots.withColumn("__named", F.lit(True)), "path_key", "left"), test | F.col("__named").isNotNull()
    return hit.where(test if how == "left_semi" else ~test).select(*rows.columns)


def collapsed(removals: DataFrame) -> DataFrame:
    """Removals without those below another."""
    return under(removals, removals, "left_anti", strictly=True)


def layered(baseline: DataFrame, deltas: DataFrame) -> DataFrame:
    """The visible entries: deltas (generation, op, path_key, and the entry's columns, kind among them) over a baseline.

    Inside a generation removals come before upserts. A removal hides what earlier
    generations put at its key and below; an upsert of anything but a directory hides what
    they put below its key, for it takes a directory's place.
    """
    columns = baseline.columns
    ups = first_of(deltas.where("op = 'upsert'"), ["path_key"], [F.desc("generation")])
    removed, hides = F.col("op") == "remove", (F.col("op") == "remove") | (F.col("kind") != "directory")
    gone = deltas.where(hides).groupBy(F.col("path_key").alias("above")).agg(F.max("generation").alias("below"), F.max(F.when(removed, F.col("generation"))).alias("here"))
    base = baseline.join(ups.select("path_key"), "path_key", "left_anti").withColumn("generation", F.lit(0).cast("long"))
    rows = base.select(*columns, "generation").unionByName(ups.select(*columns, "generation"))
    return without_hidden(rows, gone).select(*columns)


def applied(entries: DataFrame, deltas: DataFrame) -> DataFrame:
    """entries of a stored batch after deltas, in the order of generations.

    Unlike in ``layered`` a removal reaches below its key only if the row stored there by
    then is a directory's, and an upsert hides nothing.
    """
    columns = entries.columns
    stored = entries.select("path_key", F.lit(0).cast("long").alias("generation"), F.lit("upsert").alias("op"), "kind")
    before = Window.partitionBy("path_key").orderBy("generation")
    last = F.lag(F.struct("op", "kind")).over(before)
    steps = stored.unionByName(deltas.select("path_key", "generation", "op", "kind")).withColumn("was", last)
    gone = steps.where("op = 'remove'").groupBy(F.col("path_key").alias("above")).agg(F.max("generation").alias("here"), F.max(F.when((F.col("was.op") == "upsert") & (F.col("was.kind") == "directory"), F.col("generation"))).alias("below"))
    ups = first_of(deltas.where("op = 'upsert'"), ["path_key"], [F.desc("generation")])
    rows = entries.withColumn("generation", F.lit(0).cast("long")).join(ups.select("path_key"), "path_key", "left_anti").select(*columns, "generation").unionByName(ups.select(*columns, "generation"))
    return without_hidden(rows, gone).select(*columns)


def snapshot_diff(known: DataFrame, current: DataFrame) -> DataFrame:
    """path_key, change: upsert where a file is new or its time or size changed, remove where it is gone."""
    k = known.select("path_key", F.struct("modified_ms", "size_bytes").alias("k"))
    c = current.select("path_key", F.struct("modified_ms", "size_bytes").alias("c"))
    both = k.join(c, "path_key", "full")
    change = F.when(F.col("c").isNull(), "remove").when(~F.col("k").eqNullSafe(F.col("c")), "upsert")
    return both.select("path_key", change.alias("change")).where("change is not null")


def reused(scan: DataFrame, previous: DataFrame) -> DataFrame:
    """Scanned rows with the previous content state where kind, root, parent, time and size are unchanged."""
    same = ["kind", "root", "parent", "modified_ms", "size_bytes"]
    old = previous.select("path_key", F.struct(*same).alias("old"), F.col("content_index_state").alias("old_state"))
    joined = scan.join(old, "path_key", "left")
    unchanged = F.col("old").eqNullSafe(F.struct(*same))
    return joined.withColumn("reused", unchanged).withColumn("content_index_state", F.when(unchanged, F.col("old_state")).otherwise(F.col("content_index_state"))).drop("old", "old_state")


def replayed(journal: DataFrame, after: int) -> DataFrame:
    """path_key, op, generation: each path's last operation after a generation."""
    return first_of(journal.where(F.col("generation") > after), ["path_key"], [F.desc("generation"), F.desc("ordinal")]).select("path_key", "op", "generation")


def preserved(staged: DataFrame, baseline: DataFrame, failed: DataFrame) -> DataFrame:
    """Staged rows, and the baseline's rows at or below failed scopes that were not staged."""
    kept = under(baseline, failed, "left_semi").join(staged.select("path_key"), "path_key", "left_anti")
    return staged.unionByName(kept.select(*staged.columns))


def manifest_of(entries: DataFrame) -> DataFrame:
    """path_key, parent_key, root, modified_ms of the directories, the root itself included."""
    dirs = entries.where("kind = 'directory'").select("path_key", F.when(F.col("path_key") != F.col("root"), F.col("parent_key")).alias("parent_key"), "root", "modified_ms")
    return dirs


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """path_key, fault: outside its root, root with a parent, wrong parent, missing parent."""
    direct = F.col("parent_key").eqNullSafe(P.parent_key(F.col("path_key")))
    fault = F.when(~P.covers(F.col("root"), F.col("path_key")), "outside_root").when((F.col("path_key") == F.col("root")) & F.col("parent_key").isNotNull(), "root_with_parent").when((F.col("path_key") != F.col("root")) & ~direct, "wrong_parent")
    local = manifest.select("path_key", fault.alias("fault")).where("fault is not null")
    orphans = manifest.where("parent_key is not null").join(manifest.select(F.col("path_key").alias("parent_key")), "parent_key", "left_anti")
    return local.unionByName(orphans.select("path_key", F.lit("missing_parent").alias("fault")))


def repeated_keys(deltas: DataFrame) -> DataFrame:
    """generation, path_key, n of keys that a generation names more than once."""
    return deltas.groupBy("generation", "path_key").agg(F.count("*").alias("n")).where("n > 1")


def covered_roots(roots: DataFrame) -> DataFrame:
    """Roots (path_key) without duplicates and without those below another."""
    return collapsed(roots.select("path_key").distinct())


def longest_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """path_key, root: the deepest root that covers each row, null if none does."""
    roots = roots.select("path_key").where("path_key is not null").distinct()
    over = by_directory(rows.select("path_key"), lambda held: held.join(roots.select(F.col("path_key").alias("above")), "above").groupBy("__dir").agg(F.max_by("above", F.length("above")).alias("__over")))
    return over.join(roots.withColumn("__own", F.col("path_key")), "path_key", "left").select("path_key", F.coalesce("__own", "__over").alias("root"))


#: Directory names that are never scanned.
FORCED = (".git", "node_modules", "target", "$recycle.bin", "system volume information", "windows", "recovery", "appdata", ".cache", "__pycache__", ".venv", "venv")


def excluded(rows: DataFrame, root: str, names: tuple[str, ...] = FORCED, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of which a directory below the root, or the row itself, has an excluded name or matches a pattern, and those inside an application."""
    inner = F.slice(P.segments(F.expr(f"substring(path_key, {len(root) + 1})")), 1, 1 << 20)
    named = F.exists(inner, lambda s: F.lower(s).isin(*names))
    glob = F.exists(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0))), lambda s: F.lower(s).rlike(r"\.(app|exe|lnk|desktop)$"))
    for p in patterns:
        glob = glob | F.lower("path_key").rlike(P.glob_regex(p.lower() if "/" in p else "**/" + p.lower()))
    return rows.where(named | glob)


def ignore_regex(pattern: str) -> str:
    """A regular expression for paths below an ignore file's directory: * and ? stay inside a name, ** crosses names, a slash but at the end anchors."""
    body = pattern.rstrip("/")
    out = "" if "/" in body else "(?:.*/)?"
    for token in re.findall(r"^/|\*\*/|/\*\*$|\*+|\?|\[!?[^\]]+\]|\\\\.|.", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "?": "[^/]"}.get(token) or ("[^/]*" if token[0] == "*" else "" if token == "/" and not out else token.replace("[!", "[^") if token[0] == "[" else re.escape(token.lstrip("\\")))
    return f"^{out}$"


def ignore_rules(files: DataFrame) -> DataFrame:
    """dir_key, strength, line, regex, negated, only_dirs of the lines of ignore files (dir_key, source, line, text).

    source: ignore, gitignore, exclude or global, the strongest first.
    """
    strength = F.when(F.col("source") == "ignore", 4).when(F.col("source") == "gitignore", 3).when(F.col("source") == "exclude", 2).otherwise(1)
    text = F.regexp_replace("text", r"(?<!\\)\s+$", "")
    lines = files.select("dir_key", strength.alias("strength"), "line", text.alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    negated = F.col("text").startswith("!")
    to_regex = F.udf(ignore_regex)  # a call for each line of an ignore file
    return lines.select("dir_key", "strength", "line", to_regex(F.regexp_replace("text", "^!", "")).alias("regex"), negated.alias("negated"), F.col("text").endswith("/").alias("only_dirs"))


def ignore_decisions(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """path_key, ignored of rows (path_key, kind) under rules as ``ignore_rules`` gives them.

    A row and its ancestors meet the rules of the directories above them; for each the
    strongest source, then the deepest directory, then the last line decides; a path is
    ignored if it or any ancestor is. The rules go to the rows, not the rows to the rules;
    rules too many for that meet them in a shuffle.
    """
    few = rules.limit(TOLD_ROOTS + 1).count() <= TOLD_ROOTS
    rules = F.broadcast(rules) if few else rules.hint("merge")
    each = with_ancestors(rows.select("path_key", "kind").distinct())
    is_dir = (F.col("kind") == "directory") | (F.col("above") != F.col("path_key"))
    each = each.select("path_key", F.col("above").alias("item"), is_dir.alias("is_dir"), F.explode(P.ancestors(F.col("above"))).alias("dir_key"))
    ruled = each.join(rules, "dir_key").where("item != dir_key and (is_dir or not only_dirs) and substring(item, length(dir_key) + 2) rlike regex")
    decided = ruled.groupBy("path_key", "item").agg(F.max_by(~F.col("negated"), F.struct("strength", F.length("dir_key").alias("depth"), "line")).alias("no"))
    final = decided.groupBy("path_key").agg(F.bool_or("no").alias("no"))
    return rows.select("path_key").join(final, "path_key", "left").select("path_key", F.coalesce("no", F.lit(False)).alias("ignored"))
