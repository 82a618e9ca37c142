"""Removal of lines that several documents hold, by two Bloom filters.

A line's key is the line without white space at its ends, in lower case (A-Z). Keys of at
least ``least_chars`` code points that at least ``least_docs`` documents hold (two or more)
go from every document except the largest doc_id.

1. Filters: every task adds its rows' keys to a filter of what it has seen once; a key that
   is in there goes to a second one, of what was seen twice. Merged, a bit is set in the
   second filter if it is in any task's second one or in two tasks' first ones, so it has
   every key of two rows. Both have at most FILTER_BITS bits; fuller ones only let more
   keys pass.
2. Only keys that the second filter has are shuffled, as digests of 128 bits: their distinct
   documents are counted and the largest doc_id is found.
3. The numbers of the lines that go return to their rows. Rows of a digest that very many
   documents hold are dealt to several tasks.

Defined results: lines are what \\n separates; a null text stays null and counts as one
empty line; rows with equal doc_id are one document, each row is reduced by its own text;
a null doc_id comes before all others and counts as one document; all lines of a frequent
key go, also those that a document repeats; the document that keeps a key keeps all of its
lines; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, sketches, skew
from .shared import Scratch, aside, picked

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Bits of a filter at most (each is a byte inside a task), and text bytes for which one is made.
FILTER_BITS, BIT_BYTES = 1 << 25, 16
#: What is stripped from a line's ends.
SPACES = " \t\n\v\f\r"
NULL_ID = -(1 << 63)


def keys(text: str | None, least_chars: int) -> Iterator[tuple[int, bytes]]:
    """Number and key of each line that is long enough."""
    for number, line in enumerate((text or "").split("\n")):
        line = line.strip(SPACES)
        if len(line) >= least_chars:
            yield number, line.encode().translate(_LOWER)


_LOWER = arrays.LOWER_ASCII.tobytes()


class Seen:
    """The two filters of a task."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def add(self, hashes: np.ndarray) -> None:
        """hashes: each row's distinct keys, row after row."""
        found, times = np.unique(hashes, return_counts=True)
        one, two = sketches.places(found, len(self.once))
        again = (times > 1) | self.once[one] & self.once[two]
        for at in (one, two):
            self.twice[at[again]] = True
        for at in (one, two):
            self.once[at] = True

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.once) // sketches.BLOCK):
            a, b = k * sketches.BLOCK, (k + 1) * sketches.BLOCK
            yield k, np.concatenate([np.packbits(self.once[a:b]), np.packbits(self.twice[a:b])])


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two tasks' first and second filters as one pair."""
    half = len(a) // 2
    return np.concatenate([a[:half] | b[:half], a[half:] | b[half:] | a[:half] & b[:half]])


def repeated_filter(docs: DataFrame, least_chars: int, bits: int) -> np.ndarray:
    """The packed filter of the keys that two rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(bits)
        for piece in arrays.pieces(batches):
            hashes = [xxhash.xxh3_64_intdigest(key) for text in piece.column("text").to_pylist() for key in {key for _, key in keys(text, least_chars)}]
            seen.add(np.array(hashes, np.uint64))
        yield from sketches.sent(seen.blocks())

    parts = docs.select("text").transform(arrays.mapped, run, sketches.SENT)
    return sketches.bits(parts, bits, _met, lambda x: np.unpackbits(x[len(x) // 2 :]))


SUSPECTS = "id long, text_key long, key binary, lines array<int>"


def suspects(docs: DataFrame, least_chars: int, twice: np.ndarray) -> DataFrame:
    """Of each row (id, text_key) the digests of the keys that the filter has, and their line numbers."""
    shipped = docs.sparkSession.sparkContext.broadcast(twice)  # FILTER_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            own, numbers, found = [], [], []
            for k, text in enumerate(piece.column("text").to_pylist()):
                at: dict[bytes, list[int]] = {}
                for number, key in keys(text, least_chars):
                    at.setdefault(key, []).append(number)
                own += [k] * len(at)
                numbers += at.values()
                found += at
            here = np.flatnonzero(sketches.has(shipped.value, np.array([xxhash.xxh3_64_intdigest(x) for x in found], np.uint64))).tolist()
            rows = pa.array([own[j] for j in here], pa.int64())
            digests = pa.array([hashlib.blake2b(found[j], digest_size=16).digest() for j in here], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("id").take(rows), piece.column("text_key").take(rows), digests, pa.array([numbers[j] for j in here], pa.list_(pa.int32()))], names=["id", "text_key", "key", "lines"])

    return docs.select("id", "text_key", "text").transform(arrays.mapped, run, SUSPECTS)


def common_keys(found: DataFrame, least_docs: int) -> DataFrame:
    """key and keeper of each digest that enough documents hold."""
    held = found.groupBy("key", "id").agg(F.lit(1).alias("one"))
    return held.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).select("key", "keeper")


def dropped_lines(docs: DataFrame, least_chars: int, least_docs: int, bits: int, scratch: Scratch) -> DataFrame:
    """id, text_key and the numbers of the lines that go, of rows that lose any."""
    twice = repeated_filter(docs, least_chars, bits)
    found = scratch.written(suspects(docs, least_chars, twice), "suspects", "zstd")
    common = scratch.written(common_keys(found, least_docs), "common")
    gone = skew.hot(found, ["key"]).joined(found, common, "text_key").where(F.col("id") != F.col("keeper"))
    # rows alike in id and text have the same lines, once
    return gone.groupBy("id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def _reduced(docs: DataFrame, least_chars: int, least_docs: int, bits: int | None) -> DataFrame:
    """docs (with text and doc_id) with their reduced text, and __n_lines and __n_dropped."""
    bits = bits or sketches.room(sketches.text_bytes(docs), BIT_BYTES, FILTER_BITS)
    named = lambda rows: rows.withColumn("__id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("__text_key", F.xxhash64("text"))
    work = named(docs).select(F.col("__id").alias("id"), F.col("__text_key").alias("text_key"), "text")
    gone = dropped_lines(work, least_chars, least_docs, bits, Scratch(docs.sparkSession)).select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key"), F.col("gone").alias("__gone"))
    rows = named(docs).join(gone, ["__id", "__text_key"], "left").drop("__id", "__text_key")
    names = docs.columns
    schema = docs.withColumn("__n_lines", F.lit(0).cast("long")).withColumn("__n_dropped", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            texts, n_lines, n_dropped = piece.column("text").to_pylist(), [], []
            for k, numbers in enumerate(piece.column("__gone").to_pylist()):
                n_lines.append((texts[k] or "").count("\n") + 1)
                n_dropped.append(len(numbers or ()))
                if numbers:
                    out = set(numbers)
                    texts[k] = "\n".join(line for j, line in enumerate(texts[k].split("\n")) if j not in out)
            piece = piece.set_column(piece.schema.names.index("text"), "text", pa.array(texts, pa.string()))
            counts = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *counts], names=[*names, "__n_lines", "__n_dropped"])

    return rows.transform(arrays.mapped, run, schema)


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int | None = None) -> DataFrame:
    """docs without their common lines; ``bits`` of each filter follow the texts' size unless given."""
    plain, back = aside(docs, "doc_id", "text")
    return back(_reduced(plain, least_chars, least_docs, bits))


def report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the reduced text of each row."""
    rows = _reduced(picked(docs, "doc_id", "text"), least_chars, least_docs, bits)
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The report in SQL.
ORACLE = r"""
WITH ids AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, k, split[k] AS line, translate(trim(split[k], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, split, unnest(range(1, len(split) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS split FROM ids))
),
common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
"""
