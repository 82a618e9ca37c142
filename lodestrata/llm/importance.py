"""Quality by importance resampling over hashed n-grams.

Two bag-of-n-gram models, counts of hashed 3-byte grams, describe the target (texts
labelled good, a bounded sample) and the raw corpus (every text). A text's log weight is
the mean log ratio of its grams times a reference length, so that neither short nor long
texts win by their length. Gumbel noise from a hash of the id is added, and the k rows
with the largest sums are the resample.

The k-th largest is found by histograms that are refined around it, so no task orders
all rows; only the last bucket's rows are ordered.

Defined results: a text under three bytes, or null, has log weight 0; equal sums are
ordered by doc_id; rows alike in both are kept together, so ties may add rows; without
good labels every row is kept; k is the labels' share of good texts, with a margin, of
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .language import sampled
from .shared import written

BUCKETS = 1 << 15
#: Labelled rows used at most for the target, on average.
TARGET_ROWS = 24_000
REFERENCE = 256
#: Added to the good labels' share, so that noise doesn't push good texts out.
MARGIN = 0.02
CELLS = 2048
LAST_ROWS = 5000


def gram_buckets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each 3-byte gram."""
    data, off = arrays.utf8(array)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1) >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int64)
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = own[:-2] == own[2:]
    return bucket[inside], own[:-2][inside]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Grams in each bucket over all texts; a row for each bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for piece in arrays.pieces(batches):
            total += np.bincount(gram_buckets(piece.column("text"))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").transform(arrays.mapped, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the smoothed models' ratio for each bucket."""
    p, q = target + 0.5, raw + 0.5
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            bucket, own = gram_buckets(piece.column("text"))
            total = np.bincount(own, shipped.value[bucket], minlength=piece.num_rows)
            n = np.bincount(own, minlength=piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(REFERENCE * total / np.maximum(n, 1))], names=["doc_id", "log_weight"])

    return docs.select("doc_id", "text").transform(arrays.mapped, run, "doc_id long, log_weight double")


def gumbel(seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def keep_largest(rows: DataFrame, score: str, k: int) -> DataFrame:
    """The rows with a boolean ``kept``: the k largest by (score, smaller doc_id). ``rows`` is read several times."""
    edge = rows.agg(F.min(score), F.max(score), F.count("*")).first()
    low, high, n = edge
    if not n or k >= n:
        return rows.withColumn("kept", F.lit(True))
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    left = k
    while n > LAST_ROWS and high > low:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col(score) - low) / width), F.lit(CELLS - 1))
        found = rows.where((F.col(score) >= low) & (F.col(score) <= high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["cell"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high, n = r["low"], r["high"], r["n"]
    last = rows.where((F.col(score) >= low) & (F.col(score) <= high)).select("doc_id", F.col(score).alias("s"))
    if low == high:  # equal sums: by doc_id alone, found the same way
        last = keep_smallest_ids(last, left)
    else:
        last = last.withColumn("last_kept", F.rank().over(Window.orderBy(F.desc("s"), "doc_id")) <= left)
    last = last.where("last_kept").select(F.col("doc_id").alias("__id"), F.col("s").alias("__s")).distinct()
    joined = rows.join(last, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows[score] == F.col("__s")), "left")
    return joined.withColumn("kept", (F.col(score) > high) | F.col("__s").isNotNull()).drop("__id", "__s")


def keep_smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """Rows of one score with ``last_kept``: those whose doc_id is not above the k-th smallest."""
    ids, left = rows.where("doc_id is not null").select("doc_id"), k
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if k >= n:
        return rows.withColumn("last_kept", F.lit(True))
    while low < high:
        width = max(1, -(-(high - low + 1) // CELLS))
        cells = ids.where(F.col("doc_id").between(low, high)).groupBy(F.floor((F.col("doc_id") - low) / width).alias("c")).count().collect()
        for r in sorted(cells, key=lambda r: r["c"]):
            if r["count"] >= left:
                break
            left -= r["count"]
        low, high = low + r["c"] * width, min(high, low + r["c"] * width + width - 1)
    return rows.withColumn("last_kept", F.coalesce(F.col("doc_id") <= low, F.lit(False)))


def resampled(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, priority (with Gumbel noise), kept of every row."""
    good = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    n, n_good = good.agg(F.count("*"), F.count(F.when(F.col("quality") == 1, 1))).first()
    if not n_good:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("priority"), F.lit(True).alias("kept"))
    chosen = sampled(good.where("quality = 1"), TARGET_ROWS, n_good).select("doc_id").distinct()
    target = bucket_counts(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))
    rows = weighted(docs, log_ratios(target, bucket_counts(docs))).withColumn("priority", F.col("log_weight") + gumbel(seed))
    rows = written(rows, "importance")
    share = min(1.0, n_good / n + MARGIN) if keep is None else keep
    return keep_largest(rows, "priority", round(share * rows.count()))
