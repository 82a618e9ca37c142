"""What is known of a catalog's generations, roots and content index: one record, changed by compare-and-set.

Tables (manifests, content states) are written first, under names of their own; the record
names them, so a change of several of them is seen whole or not at all, and a change whose
condition no longer holds is refused.

record: generations (id: root, state, fingerprint, manifest, updated_at_ms), active (root:
id), counters (root: name: number), content (index, states) or null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes as C
from . import versions as V
from .content_index import Index
from .fulltext import ContentQuery
from .store import State

MANIFEST = "path_key string, parent_key string, root string, modified_ms long"
STATES = ("building", "prepared", "active", "obsolete")


class CatalogState:
    """The state of a catalog below ``place``."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place
        self.state = State(spark, f"{place}/state")

    def record(self) -> dict:
        return {"generations": {}, "active": {}, "counters": {}, "content": None} | self.state.read()[1]

    def _update(self, change) -> bool:
        blank = {"generations": {}, "active": {}, "counters": {}, "content": None}
        return self.state.update(lambda r: change(blank | r)) is not None

    # ------------------------------------------------------------ generations

    def set_state(self, batch_id: int, state: str, at_ms: int, root: str | None = None) -> bool:
        """Puts a generation into a state; a new one needs its root. Activating takes a prepared one and retires its root's active one."""

        def change(r: dict) -> dict | None:
            known = r["generations"].get(str(batch_id))
            if state not in STATES or known is None and root is None:
                return None
            if state == "active":
                if known is None or known["state"] != "prepared":
                    return None
                before = r["active"].get(known["root"])
                if before is not None:
                    r["generations"][str(before)]["state"] = "obsolete"
                r["active"][known["root"]] = batch_id
            r["generations"][str(batch_id)] = (known or {"root": root, "fingerprint": "", "manifest": None}) | {"state": state, "updated_at_ms": at_ms}
            return r

        return self._update(change)

    def set_fingerprint(self, batch_id: int, fingerprint: str) -> bool:
        """Of a generation that there is."""

        def change(r: dict) -> dict | None:
            if str(batch_id) not in r["generations"]:
                return None
            r["generations"][str(batch_id)]["fingerprint"] = fingerprint
            return r

        return self._update(change)

    def active_fingerprint(self, root: str) -> str | None:
        r = self.record()
        active = r["active"].get(root)
        return None if active is None else r["generations"][str(active)]["fingerprint"]

    def set_manifest(self, batch_id: int, manifest: DataFrame, at_ms: int) -> bool:
        """Replaces the manifest of a prepared generation; faulty rows, and generations that aren't prepared (any more), are refused."""
        known = self.record()["generations"].get(str(batch_id))
        if known is None or known["state"] != "prepared":
            return False
        name = uuid.uuid4().hex
        raw = f"{self.place}/manifests/{name}-raw"
        manifest.select("path_key", "parent_key", "root", F.col("modified_ms").cast("long")).write.parquet(raw)  # made once, then checked and sorted
        rows = self.spark.read.schema(MANIFEST).parquet(raw)
        try:
            if not C.manifest_faults(rows).isEmpty():
                return False
            rows.repartitionByRange("path_key").sortWithinPartitions("path_key").write.parquet(f"{self.place}/manifests/{name}")
        finally:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(raw)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

        def change(r: dict) -> dict | None:
            known = r["generations"].get(str(batch_id))
            if known is None or known["state"] != "prepared":
                return None
            known |= {"manifest": name, "updated_at_ms": at_ms}
            return r

        return self._update(change)

    def manifest(self, batch_id: int) -> DataFrame:
        name = self.record()["generations"].get(str(batch_id), {}).get("manifest")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.place}/manifests/{name}") if name else self.spark.createDataFrame([], MANIFEST)

    # ------------------------------------------------------------ counters

    def save_counters(self, root: str, **counters: int) -> bool:
        """Numbers of a root, in place of those of the same names."""

        def change(r: dict) -> dict:
            r["counters"][root] = r["counters"].get(root, {}) | counters
            return r

        return self._update(change)

    # ------------------------------------------------------------ content

    def attach(self, index: str, states: DataFrame) -> bool:
        """An index's place, and the states (path_key, state) of what it holds, in place of both that were there."""
        name = uuid.uuid4().hex
        states.select("path_key", "state").write.parquet(f"{self.place}/content_states/{name}")
        return self._update(lambda r: r | {"content": {"index": index, "states": name}})

    def detach(self) -> str | None:
        """Lets go of the index; its place, null if there was none."""
        found: list[str | None] = []

        def change(r: dict) -> dict:
            found.append(r["content"]["index"] if r["content"] else None)
            return r | {"content": None}

        self._update(change)
        return found[-1]

    def entries(self, entries: DataFrame) -> DataFrame:
        """entries with the content states of the attached index; without one none is indexed."""
        content = self.record()["content"]
        blank = entries.withColumn("content_index_state", F.when(F.col("content_index_state") == "indexed", "not_indexed").otherwise(F.col("content_index_state")))
        if not content:
            return blank
        return V.with_content_states(blank, self.spark.read.parquet(f"{self.place}/content_states/{content['states']}"))

    def content_search(self, entries: DataFrame, query: ContentQuery, k: int) -> DataFrame:
        """path_key, score of the best texts whose entries the attached index has indexed."""
        content = self.record()["content"]
        if not content:
            return self.spark.createDataFrame([], "path_key string, score double")
        only = self.entries(entries).where("content_index_state = 'indexed'").select("path_key")
        return Index(self.spark, content["index"]).top(query, k, only)
