"""Conflict-constrained best-fit packing of documents into bins of words.

A document of more than ``capacity`` words is cut into full bins of its own and a rest;
rests and whole documents are packed. Bins are kept in order of residual room and carry
two bitmaps, of sources and of duplicate clusters. A piece goes to the tightest bin that
has room and no conflict: from the first bin that is large enough the search goes on to
its successors until the bitmaps allow it. A bin holds one member of a duplicate cluster
and at most ``per_source`` pieces of a source (a bit for each place). Pieces come in
falling size.

Documents are dealt to shards by a hash of their id, content and, of rows that are alike,
their number; a shard's bins are its own. The number of shards follows the number of
documents, so a task's work is bounded, however large a source, a cluster or a repeated
row is.

Defined results: a text without words takes no room and joins no bin (bin null, length
0); a null source is a source of its own; texts with the same words in lower
case are one cluster unless ``cluster`` names a column of docs, whose null is in no
cluster; rows that repeat a doc_id are packed one by one, and rows alike in id, source,
size and cluster are equals, so results don't depend on the order of rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import WORD
from .shared import aside

CAPACITY = 2048
PER_SOURCE = 8
#: Documents of a shard, on average.
SHARD_ROWS = 4000


class Bins:
    """Open bins of one shard in order of (residual room, number)."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int | None) -> tuple[int, int]:
        """Bin and offset of a piece; ``source`` and ``cluster`` are bit numbers in this shard."""
        k = self.per_source
        full = ((1 << k) - 1) << source * k
        member = 0 if cluster is None else 1 << cluster
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, bin_no = self.order[at]
            if not self.clusters[bin_no] & member and self.sources[bin_no] & full != full:
                del self.order[at]
                break
            at += 1
        else:
            room, bin_no = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        taken = self.sources[bin_no] & full
        self.sources[bin_no] |= (taken << 1 | 1 << source * k) & full
        self.clusters[bin_no] |= member
        if room > size:
            insort(self.order, (room - size, bin_no))
        return bin_no, self.capacity - room


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Pieces of one shard's documents: doc_id, piece, bin, offset, length."""
    rows = rows.sort_values(["size", "doc_id", "cluster", "source"], ascending=[False, True, True, True], na_position="last")
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0].tolist()
    counts = rows["cluster"].value_counts()
    bits = {c: k for k, c in enumerate(sorted(counts.index[counts > 1]))}
    bins, out, rests = Bins(capacity, per_source), [], []
    full = 0  # full bins are numbered after the shared ones
    for doc, size, source, cluster in zip(rows["doc_id"].tolist(), rows["size"].tolist(), sources, rows["cluster"].tolist()):
        whole, rest = divmod(size, capacity)
        for piece in range(whole):
            out.append((doc, piece, -1 - full, 0, capacity))
            full += 1
        if rest or not size:
            rests.append((rest, doc, whole, source, bits.get(cluster)))
    for rest, doc, piece, source, cluster in sorted(rests, key=lambda r: -r[0]):
        if rest:
            bin_no, offset = bins.place(rest, source, cluster)
            out.append((doc, piece, bin_no, offset, rest))
        else:
            out.append((doc, piece, None, 0, 0))
    frame = pd.DataFrame(out, columns=["doc_id", "piece", "bin", "offset", "length"]).astype({"bin": "Int64"})
    frame["doc_id"] = pd.array([None if d is None else int(d) for d in frame["doc_id"]], "Int64")
    frame.loc[frame["bin"] < 0, "bin"] = len(bins.sources) - 1 - frame["bin"]
    return frame


PIECES = "shard long, bin long, doc_id long, piece long, offset long, length long"


def packed(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """shard, bin, doc_id, piece, offset, length: (shard, bin) is a bin; a document has a row for each piece."""
    rows = aside(docs, "doc_id", "text", "source", *([cluster] if cluster else []))[0]
    text = F.col("text")
    group = F.col(cluster).cast("string") if cluster else F.md5(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))))
    sized = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), group.alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    # alike rows are counted, numbered and so dealt apart
    alike = sized.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("copies"))
    each = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    each = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard"), F.when(F.col("doc_id").isNull(), F.col("cluster")), F.when(F.col("copy") > 1, F.col("copy"))), F.lit(shards)))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(rows, capacity, per_source)
        out.insert(0, "shard", key[0])
        return out[["shard", "bin", "doc_id", "piece", "offset", "length"]]

    return each.groupBy("shard").applyInPandas(pack, PIECES)
