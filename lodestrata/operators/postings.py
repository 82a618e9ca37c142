"""Postings: what leads from grams, extensions and segments to entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .search import directory_segments


def name_grams(entries: DataFrame) -> DataFrame:
    """path_key, gram: the distinct grams of one to three characters of each name."""
    name = P.ascii_lower(F.col("name"))
    grams = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, n))).otherwise(F.array().cast("array<string>"))))
    return entries.select("path_key", F.explode(F.array_distinct(grams)).alias("gram"))


def gram_counts(entries: DataFrame) -> DataFrame:
    """gram, n: in how many entries' names each gram of ``name_grams`` is; counted a batch at a time, then summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name = pc.fill_null(batch.column("name"), "")
            code = np.frombuffer("".join(name.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
            length = np.asarray(pc.utf8_length(name)).astype(np.int64)
            owner = np.repeat(np.arange(len(length)), length)
            left = np.cumsum(length)[owner] - np.arange(len(code))  # characters of the name from here on
            for size in (1, 2, 3):
                at = np.flatnonzero(left >= size)
                gram = sum((code[at + k] + 1) << 21 * k for k in range(size))  # 21 bits hold a code point
                order = np.lexsort((owner[at], gram))
                gram, name_of = gram[order], owner[at][order]
                once = np.ones(len(gram), bool)
                once[1:] = (gram[1:] != gram[:-1]) | (name_of[1:] != name_of[:-1])
                found, n = np.unique(gram[once], return_counts=True)
                texts = ["".join(chr((g >> 21 * k & 0x1FFFFF) - 1) for k in range(size)) for g in found.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["gram", "n"])

    names = entries.select(P.ascii_lower(F.col("name")).alias("name"))
    return names.mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def with_gram(entries: DataFrame, gram: str) -> DataFrame:
    """path_key of the entries with this gram of ``name_grams``; no other grams are made."""
    return entries.where(P.ascii_lower(F.col("name")).contains(gram) if 1 <= len(gram) <= 3 else F.lit(False)).select("path_key")


def with_segment(entries: DataFrame, segment: str) -> DataFrame:
    """path_key of the entries with this segment of ``path_segments``; no other segments are made."""
    return entries.where(F.array_contains(F.transform(directory_segments(), P.ascii_lower), segment)).select("path_key")


def extensions(entries: DataFrame) -> DataFrame:
    return entries.select("path_key", P.ascii_lower(P.effective_extension(F.col("name"), F.col("extension"))).alias("extension")).where("extension is not null")


def path_segments(entries: DataFrame) -> DataFrame:
    return entries.select("path_key", F.explode(F.array_distinct(F.transform(directory_segments(), P.ascii_lower))).alias("segment"))


def holding(postings: DataFrame, column: str, value: str) -> DataFrame:
    return postings.where(F.col(column) == value).select("path_key")
