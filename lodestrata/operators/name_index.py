"""A stored index of names and directories that searches read instead of all entries.

Entries are written once in the order of path_key and path, with their place in it as a
dense ``id``; so those below a directory are neighbours, and a scope is a range of keys
that Parquet's statistics find. Beside them stand:

* postings: of each gram of a name (one to three characters) and of each extension the ids,
  in blocks of BLOCK, as offsets inside the block. A block's postings are made together and
  don't move afterwards; each file is sorted by value, so that a search reads its values'
  row groups only;
* directories: the first and last id below each, its own id, and its name.

A search intersects the rarest of its constraints' blocks first, then reads the entries of
the remaining blocks, the first of them first, until the limit is reached. What it finds
equals ``search.search`` over the entries.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from . import search as S
from .search import FileQuery
from .store import numbered

#: Ids of a block.
BLOCK = 1 << 13
#: Blocks that are read first, and how many times more each time the limit isn't reached.
FIRST_BLOCKS, MORE = 4, 16
#: Blocks that are told to the scan by name; more are joined.
TOLD_BLOCKS = 4096


#: What ``block_postings`` gives.
POSTINGS = "kind string, value string, block long, n int, offsets array<int>"


def block_postings(rows: pa.Table) -> pa.Table:
    """kind, value, block, n, offsets (rising) of the grams and extensions of a block's names (block, offset, name, extension)."""
    parts = []
    offset = rows.column("offset").to_numpy().astype(np.int64)
    names = rows.column("name").combine_chunks()
    known = np.asarray(pc.is_valid(names))
    texts = pc.fill_null(names, "")
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    owner = np.repeat(np.arange(len(length)), length)
    left = np.cumsum(length)[owner] - np.arange(len(code))  # characters of the name from here on
    for n in (1, 2, 3):
        at = np.flatnonzero((left >= n) & known[owner])
        gram = sum((code[at + k] + 1) << 21 * k for k in range(n))  # 21 bits hold a code point
        parts.append(_posted(gram, offset[owner[at]], lambda found, n=n: ["".join(chr((g >> 21 * k & 0x1FFFFF) - 1) for k in range(n)) for g in found.tolist()], "gram"))
    extension = rows.column("extension").combine_chunks().dictionary_encode()
    has = np.flatnonzero(np.asarray(pc.is_valid(extension)))
    value = extension.dictionary.to_pylist()
    index = np.asarray(pc.fill_null(extension.indices, 0)).astype(np.int64)
    parts.append(_posted(index[has], offset[has], lambda found: [value[k] for k in found.tolist()], "extension"))
    out = pa.concat_tables([p for p in parts if p.num_rows] or parts[:1])
    return out.add_column(2, "block", pa.array(np.full(out.num_rows, rows.column("block")[0].as_py()), pa.int64()))


def _posted(value: np.ndarray, offset: np.ndarray, texts: Callable[[np.ndarray], list[str]], kind: str) -> pa.Table:
    """kind, value, n, offsets: the distinct offsets of each value, as text."""
    order = np.lexsort((offset, value))
    value, offset = value[order], offset[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (offset[1:] != offset[:-1])
    value, offset = value[new], offset[new]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    ends = np.r_[first, len(value)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(offset.astype(np.int32)))
    return pa.table({"kind": pa.array([kind] * len(first), pa.string()), "value": pa.array(texts(value[first]), pa.string()), "n": pa.array(np.diff(ends), pa.int32()), "offsets": lists})


class NameIndex:
    """A stored index below ``place``."""

    def __init__(self, spark: SparkSession, place: str, block: int = BLOCK):
        self.spark, self.place, self.block = spark, place, block

    # ------------------------------------------------------------ writing

    def build(self, entries: DataFrame) -> None:
        ids = numbered(entries, ["path_key", "path"], f"{self.place}/placed")
        rows = ids.withColumn("block", F.floor(F.col("id") / self.block))
        rows.sortWithinPartitions("id").write.parquet(f"{self.place}/entries")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.place}/entries")
        extension = P.ascii_lower(P.effective_extension(F.col("name"), F.col("extension")))
        named = rows.select("block", (F.col("id") % self.block).cast("int").alias("offset"), P.ascii_lower(F.col("name")).alias("name"), extension.alias("extension"))
        blocks = named.groupBy("block").applyInArrow(block_postings, POSTINGS)
        blocks.sortWithinPartitions("kind", "value", "block").write.parquet(f"{self.place}/postings")
        self._directories(rows).write.parquet(f"{self.place}/directories")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.place}/placed")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def _directories(rows: DataFrame) -> DataFrame:
        """segment, written, dir, first and last id below, own id (of a directory's entry) of every directory."""
        ids, none = F.col("id"), F.lit(None).cast("long")
        # entries of one directory have the same ancestors
        filed = rows.groupBy(F.regexp_replace("path_key", r"[^/\\]+[/\\]*$", "").alias("up")).agg(F.min(ids).alias("first"), F.max(ids).alias("last"))
        below = filed.select(F.explode(P.ancestors(F.col("up"))).alias("dir"), "first", "last", none.alias("own"))
        owned = rows.where("kind = 'directory'").select(F.element_at(P.ancestors(F.col("path_key")), -1).alias("dir"), none.alias("first"), none.alias("last"), ids.alias("own"))
        dirs = below.unionByName(owned).groupBy("dir").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("own").alias("own")).withColumn("seen", F.least("first", "own"))
        written = F.regexp_replace(F.try_element_at(P.segments(F.col("dir")), F.lit(-1)), ":+$", "")  # null for a root without a name
        return dirs.withColumn("written", written).withColumn("segment", P.ascii_lower(F.col("written"))).where("segment is not null")

    # ------------------------------------------------------------ reading

    def entries(self) -> DataFrame:
        """All entries, with id and block."""
        return self.spark.read.parquet(f"{self.place}/entries")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/postings")

    def directories(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/directories")

    def scope(self, *roots: str) -> DataFrame:
        """The entries at or below any of the roots: ranges of keys."""
        return self.entries().where(reduce(lambda a, b: a | b, map(key_range, roots), F.lit(False)))

    def _holding(self, kind: str, value: str) -> DataFrame:
        """block, offsets of a value."""
        return self.postings().where((F.col("kind") == kind) & (F.col("value") == value)).select("block", "offsets")

    def _segments(self, terms: list[str], dirs: list[str], most: int) -> list[list[str]] | None:
        """Per term and directory constraint the segments that qualify; None if they are very many."""
        if not terms and not dirs:
            return []
        table = self.directories().groupBy("segment").agg(F.min_by("written", "seen").alias("written"))
        rows = S.sought_segments(table, terms + dirs)
        found = rows.limit(most + 1).collect()
        return None if len(found) > most else S.kept_segments(found, terms, dirs)

    def _filed_blocks(self, segments: list[str]) -> DataFrame:
        """block, offsets (null: any) of every entry that is filed under one of the segments."""
        dirs = self.directories().where(F.col("segment").isin(*segments)) if segments else self.directories().limit(0)
        at = lambda c: F.floor(F.col(c) / self.block)
        ranges = F.when(F.col("first").isNotNull(), F.sequence(at("first"), at("last"))).otherwise(F.array().cast("array<long>"))
        return dirs.select(F.explode(F.concat(ranges, F.array_compact(F.array(at("own"))))).alias("block")).distinct().withColumn("offsets", F.lit(None).cast("array<int>"))

    def search(self, query: FileQuery, limit: int = 20, visible: Column | None = None, most: int = S.SEGMENTS) -> DataFrame:
        """What ``search.search`` finds in the entries."""
        low = lambda texts: [S._lower(t) for t in texts]
        terms, dirs = low(query.terms), low(query.dirs)
        plain = limit > 0 and not any(re.search(r"[/\\]", t) or not t.strip() for t in terms) and not any(re.search(r"[*?\[]", d) for d in dirs)
        segments = self._segments(terms, dirs, most) if plain else None
        columns = [c for c in self.entries().columns if c not in ("id", "block")]
        if segments is None or not (terms or dirs or query.names or query.types):
            return S.search(self.entries().select(*columns), query, limit, visible, most)
        under = [S.under_any(some) for some in segments]
        test = S.matches(query)
        for u in under[len(terms) :]:
            test &= u
        if visible is not None:
            test &= visible
        # what holds of all hits, as blocks
        fixed = [self._filed_blocks(some) for some in segments[len(terms) :]]
        fixed += [self._holding("gram", part[k : k + 3]) for part in low(query.names) if part for k in range(max(len(part) - 2, 1))]
        fixed += [self._holding("extension", x.lstrip(".")) for x in low(query.types)]
        named = [P.ascii_lower(F.col("name")).contains(t[:3]) for t in terms]
        if len(terms) == 1:
            by_name = self._first([*fixed, self._holding("gram", terms[0][:3])], test & named[0], limit)
            n = by_name.count()
            if n >= limit:
                return by_name.select(*columns)
            rest = self._first([*fixed, self._filed_blocks(segments[0])], test & ~named[0] & under[0], limit - n)
            both = by_name.withColumn("rest", F.lit(False)).unionByName(rest.withColumn("rest", F.lit(True)))
            return both.orderBy("rest", "id").select(*columns)
        for t, name, some, filed in zip(terms, named, segments, under):
            fixed.append(self._holding("gram", t[:3]).select("block").unionByName(self._filed_blocks(some).select("block")).distinct().withColumn("offsets", F.lit(None).cast("array<int>")))
            test &= name | filed
        return self._first(fixed, test, limit).select(*columns)

    def _first(self, constraints: list[DataFrame], test: Column, limit: int) -> DataFrame:
        """The first ``limit`` entries that pass the test, in blocks that all constraints (block, offsets; null: any) have in common."""
        blocks = reduce(_met, constraints).select("block")
        known = [r["block"] for r in blocks.orderBy("block").limit(TOLD_BLOCKS + 1).collect()]
        size = FIRST_BLOCKS
        while True:
            all_ = size > TOLD_BLOCKS or size >= len(known)
            if all_ and len(known) > TOLD_BLOCKS:
                rows = self.entries().join(blocks, "block", "left_semi")
            else:
                rows = self.entries().where(F.col("block").isin(*known[:size]))
            found = rows.where(test).orderBy("id").limit(limit)
            if all_ or found.count() >= limit:
                return found
            size *= MORE


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks of both, with the offsets of both."""
    both = a.join(b.select("block", F.col("offsets").alias("other")), "block")
    offsets = F.when(F.col("offsets").isNull(), F.col("other")).when(F.col("other").isNull(), F.col("offsets")).otherwise(F.array_intersect("offsets", "other"))
    return both.select("block", offsets.alias("offsets")).where("offsets is null or size(offsets) > 0")


def key_range(root: str) -> Column:
    """Keys at or below a root, as comparisons that Parquet's statistics answer."""
    if root == "/":
        return F.col("path_key").startswith("/")
    return (F.col("path_key") == root) | ((F.col("path_key") >= f"{root}/") & (F.col("path_key") < f"{root}0"))  # 0 follows /

