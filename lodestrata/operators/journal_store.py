"""A stored catalog: a baseline of entries, and a journal of changes that were committed since.

A commit writes its rows under a name of its own and then one record, named by the
generation, that makes them count: the first writer's record stays, a retry with the same
rows changes nothing, other rows for the same generation are refused. The baseline is
named by a state record, which changes by compare-and-set.

place/payloads/<name>: generation, ordinal, op, path_key and the entry's columns;
place/commits/<generation>: digest, n, payload; place/baseline: entries, generation.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import changes as C
from . import journal as J
from .store import Folder, State, numbered, union


@dataclass(frozen=True)
class Recovered:
    """The visible entries, up to which generation, how (replayed, baseline_only or unavailable), and why not whole."""

    entries: DataFrame | None
    generation: int
    mode: str
    code: str | None = None


class Catalog:
    """A catalog below ``place`` whose entries have these columns (path_key and kind among them)."""

    def __init__(self, spark: SparkSession, place: str, entry_schema):
        self.spark, self.place = spark, place
        self.entry_schema = spark.createDataFrame([], entry_schema).schema
        self.columns = self.entry_schema.names
        self.commits, self.baseline = Folder(spark, f"{place}/commits"), State(spark, f"{place}/baseline")

    # ------------------------------------------------------------ journal

    @property
    def _payload_schema(self):
        fixed = self.spark.createDataFrame([], "generation long, ordinal long, op string").schema
        return type(fixed)([*fixed.fields, *self.entry_schema.fields])

    def commit(self, generation: int, delta: DataFrame) -> str:
        """append, done (the same rows are there), conflict (others are) or invalid, for (op, entry's columns); upserts count before removals."""
        name = uuid.uuid4().hex
        place, payload = self.commits.jvm.org.apache.hadoop.fs.Path(f"{self.place}/payloads/{name}"), f"{self.place}/payloads/{name}/rows"
        rows = delta.select("op", *self.columns).withColumn("later", F.when(F.col("op") == "upsert", 0).otherwise(1))
        rows = numbered(rows, ["later", "path_key", "op"], f"{self.place}/payloads/{name}/placed")
        rows.select(F.lit(generation).cast("long").alias("generation"), F.col("id").alias("ordinal"), "op", *self.columns).write.parquet(payload)
        rows = union(self.spark, [payload], self._payload_schema)
        if not J.faults(rows).isEmpty():
            self.commits.fs.delete(place, True)
            return "invalid"
        found = J.digests(rows, ["generation"], ["ordinal", "op", *self.columns]).first()
        record = {"generation": generation, "digest": found["digest"] if found else "", "n": found["n"] if found else 0, "payload": f"{name}/rows"}
        if self.commits.put(f"{generation:020d}", json.dumps(record)):
            return "append"
        self.commits.fs.delete(place, True)
        return "done" if json.loads(self.commits.read(f"{generation:020d}"))["digest"] == record["digest"] else "conflict"

    def committed(self, after: int = -1) -> list[dict]:
        """The commit records after a generation, in order: one small record a generation since the baseline."""
        return [json.loads(self.commits.read(n)) for n in self.commits.names() if int(n) > after]

    def journal(self, after: int = -1) -> DataFrame:
        """generation, ordinal, op and entry of every committed change after a generation."""
        return union(self.spark, [f"{self.place}/payloads/{r['payload']}" for r in self.committed(after)], self._payload_schema)

    # ------------------------------------------------------------ baseline

    def install(self, entries: DataFrame, generation: int) -> bool:
        """Puts a new baseline of a generation in place, to go on with the journal after it.

        Refused where the journal after it has gaps, or ends (or the baseline stands, where
        nothing follows) before the generation that the catalog has reached; also where
        another writer was first.
        """
        version, record = self.baseline.read()
        tail = [r["generation"] for r in self.committed(generation)]
        head = max([record.get("generation", -1), *(r["generation"] for r in self.committed(record.get("generation", -1)))])
        if tail != list(range(generation + 1, generation + 1 + len(tail))) or (tail or [generation])[-1] < head:
            return False
        name = uuid.uuid4().hex
        entries.select(*self.columns).write.parquet(f"{self.place}/entries/{name}")
        return self.baseline.put(version, {"entries": name, "generation": generation})

    def recover(self, manifest: DataFrame | None = None) -> Recovered:
        """The entries as they are after a restart: the journal replayed on the baseline, or, where it can't be, the baseline alone."""
        _, record = self.baseline.read()
        if not record:
            return Recovered(None, -1, "unavailable")
        generation = record["generation"]
        base = union(self.spark, [f"{self.place}/entries/{record['entries']}"], self.entry_schema)
        tail = self.committed(generation)
        code = None
        if manifest is not None and not C.manifest_faults(manifest).isEmpty():
            code = "manifest_invalid"
        elif [r["generation"] for r in tail] != list(range(generation + 1, generation + 1 + len(tail))):
            code = "journal_gap"
        else:
            journal = self.journal(generation)
            counts = {r["generation"]: (r["n"], r["digest"]) for r in J.digests(journal, ["generation"], ["ordinal", "op", *self.columns]).collect()}  # a row a generation
            if any(counts.get(r["generation"], (0, "")) != (r["n"], r["digest"]) for r in tail) or not J.faults(journal).isEmpty():
                code = "journal_invalid"
        if code:
            return Recovered(base, generation, "baseline_only", code)
        if not tail:
            return Recovered(base, generation, "replayed")
        return Recovered(C.layered(base, journal), tail[-1]["generation"], "replayed")


# ---------------------------------------------------------------- counts


def touched(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows (path_key) at or below a key of the delta."""
    return C.under(rows, delta.select("path_key").distinct(), "left_semi")


def bearing(journal: DataFrame, delta: DataFrame) -> DataFrame:
    """Changes that bear on what is at or below a key of the delta: there, or at a directory above."""
    keys = delta.select("path_key").distinct()
    above = C.with_ancestors(keys).select(F.col("above").alias("path_key")).distinct()
    inside = C.under(journal, keys, "left_semi")
    return inside.unionByName(journal.join(above.join(keys, "path_key", "left_anti"), "path_key", "left_semi"))


def count_change(baseline: DataFrame, journal: DataFrame, delta: DataFrame) -> int:
    """By how much the visible rows of baseline and journal change with one more generation, from what it touches alone."""
    keys = delta.select("path_key").distinct()
    few = keys.limit(C.TOLD_ROOTS + 1).collect()
    if len(few) <= C.TOLD_ROOTS:
        keys = delta.sparkSession.createDataFrame(few, keys.schema)
    rows, known = touched(baseline, keys), bearing(journal, keys)
    before = touched(C.layered(rows, known), keys).select(F.lit(-1).alias("n"))
    after = touched(C.layered(rows, known.unionByName(delta.select(*journal.columns))), keys).select(F.lit(1).alias("n"))
    return before.unionByName(after).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def counts(baseline: DataFrame, journal: DataFrame, generations: list[int]) -> dict[int, int]:
    """The visible rows of baseline and journal after each of these generations, in one pass over both.

    A row counts from its generation to the one that replaces or hides it, as in ``layered``.
    """
    change = F.col("generation")
    ups = journal.where("op = 'upsert'").select("path_key", "generation").distinct()
    rows = baseline.select("path_key", F.lit(0).cast("long").alias("generation")).unionByName(ups)
    later = Window.partitionBy("path_key").orderBy("generation").rangeBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("__next", F.min("generation").over(later))
    hides = journal.where((F.col("op") == "remove") | (F.col("kind") != "directory")).select(F.col("path_key").alias("above"), change.alias("at")).distinct()
    gone = journal.where("op = 'remove'").groupBy("path_key").agg(F.collect_set(change).alias("__here"))  # at most one for each generation
    rows = C.by_directory(rows, lambda held: held.join(hides, "above").groupBy("__dir").agg(F.collect_set("at").alias("__below"))).join(gone, "path_key", "left")
    first = lambda name: F.array_min(F.filter(name, lambda g: g > change))
    rows = rows.select("generation", F.least("__next", first("__here"), first("__below")).alias("end"))
    seen = lambda g: F.count(F.when((change <= g) & F.coalesce(F.col("end") > g, F.lit(True)), 1)).alias(f"g{g}")
    found = rows.agg(*map(seen, generations)).first()
    return {g: found[f"g{g}"] for g in generations}
