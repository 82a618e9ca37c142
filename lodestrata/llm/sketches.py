"""Sketches that tasks make of their rows, merged by blocks, and the bits of the result that are told to all tasks.

A sketch has a bounded number of cells whatever the table's size. A fuller one only lets
more rows through; what uses it confirms them exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Cells of a block: what is merged as one row.
BLOCK = 1 << 16
SENT = "block int, cells binary"


def places(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash; ``cells`` is a power of two.

    Both are in the block that the hash's highest bits name, so that sorted hashes meet one
    block after the other, and not cells all over the sketch.
    """
    width = min(cells, BLOCK)
    low, mixed = np.uint64(width - 1), arrays.mix(hashes)
    block = hashes >> np.uint64(32) >> np.uint64(32 - (cells // width).bit_length() + 1)
    block *= np.uint64(width)
    return (block | mixed & low).view(np.int64), (block | mixed >> np.uint64(32) & low).view(np.int64)


def add(counts: np.ndarray, hashes: np.ndarray) -> None:
    """Adds each hash once to a count-min sketch of saturating bytes.

    The lesser of a hash's two cells, and how often it comes now, bound its number; a cell
    is raised to the highest bound of those that meet in it, not to their sum. Sketches of
    several tasks, added up, bound the numbers over all of them.
    """
    found, times = np.unique(hashes, return_counts=True)
    one, two = places(found, len(counts))
    bound = np.minimum(np.minimum(counts[one], counts[two]) + times, 255).astype(np.uint8)
    np.maximum.at(counts, one, bound)
    np.maximum.at(counts, two, bound)


def room(size: int, each: int, most: int) -> int:
    """A power of two of cells: about one for each ``each`` of size, from BLOCK to ``most``."""
    return max(BLOCK, min(most, 1 << max(int(size // each), 1).bit_length()))


def sent(blocks: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of SENT for the blocks that hold something."""
    for k, cells in blocks:
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], names=["block", "cells"])


def bits(parts: DataFrame, cells: int, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The merged sketch's packed bits, one a cell: ``finish`` makes a block's BLOCK bits of its merged cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # all blocks at most: the sketch's own size
        for batch in batches:
            for k, packed in zip(batch.column("block").to_pylist(), batch.column("cells")):
                new = np.frombuffer(zlib.decompress(packed.as_buffer()), np.uint8)
                held[k] = merge(held[k], new) if k in held else new
        yield from sent((k, np.packbits(finish(x))) for k, x in held.items())

    blocks = cells // BLOCK
    merged = parts.repartition(min(blocks, 64), "block").transform(arrays.mapped, run, SENT)
    out = np.zeros((blocks, BLOCK // 8), np.uint8)
    for r in merged.toArrow().to_pylist():  # cells / 8 bytes in all
        out[r["block"]] = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
    return out.reshape(-1)


def has(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    one, two = places(hashes, 8 * len(packed))
    return (packed[one >> 3] << (one & 7).astype(np.uint8) & packed[two >> 3] << (two & 7).astype(np.uint8) & np.uint8(128)).astype(bool)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
