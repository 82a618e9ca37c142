"""Numpy views over Arrow text batches, shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workers import lean

#: Text bytes handled at once inside a task; bounds a Python worker's memory.
PIECE_BYTES = 1 << 18
#: Rows of an Arrow batch where the session doesn't say; Spark's own default is for narrow rows.
BATCH_ROWS, DEFAULT_ROWS = 400, "10000"

#: The ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[list(SPACES)] = False
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mapped(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches that are small enough for rows of whole texts."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return rows.mapInArrow(lean(function), schema)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text is about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        group = np.cumsum(size) // limit
        cut = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that holds each byte position."""
    return np.searchsorted(off, at, side="right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every run of non-space bytes; a run never crosses texts."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = WORD_BYTE[data]
    here = solid[1:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(here & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(here & (~solid[2:] | edge[1:])) + 1
    return start, end, owner(off, start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 4096)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * BASE**j over j < i: the prefix polynomial hashes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = data
    out[1:] += np.uint64(1)
    out[1:] *= up
    return np.cumsum(out, out=out)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of data[start:end], the same wherever these bytes stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))
    return first, np.diff(np.append(first, n))


def ramps(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


#: Bits of an id filter at most (4 MB); a fuller one only lets more rows through.
FILTER_BITS = 1 << 25


class IdFilter:
    """A Bloom filter of ids: two bits each, about eight bits of room for each id up to FILTER_BITS."""

    def __init__(self, ids: DataFrame, column: str, most: int):
        self.bits = max(1 << 10, min(FILTER_BITS, 1 << (8 * most).bit_length()))  # most: how many ids there can be

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(self.places(batch.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(1, at & 31))], names=["word", "bit"])

        words = ids.select(column).transform(mapped, places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        self.words = np.zeros(self.bits >> 5, np.uint32)
        self.words[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)

    def places(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spread = mix(np.asarray(ids.cast(pa.int64()).fill_null(0)).view(np.uint64) + BASE)
        return tuple((spread >> np.uint64(k) & np.uint64(self.bits - 1)).astype(np.int64) for k in (0, 32))

    def has(self, ids: pa.Array) -> np.ndarray:
        """Whether each id may be in it; never false for one that is."""
        one, two = self.places(ids)
        return (self.words[one >> 5] >> (one & 31).astype(np.uint32) & self.words[two >> 5] >> (two & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def packed_texts(rows: DataFrame, key: str = "id", among: IdFilter | None = None) -> DataFrame:
    """key and ``packed``, the text deflated: what is shuffled where texts have to move; ``among`` leaves out most rows that a join on the key would drop."""
    shipped = among and rows.sparkSession.sparkContext.broadcast(among)  # FILTER_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            if shipped:
                piece = piece.filter(pa.array(shipped.value.has(piece.column(key))))
            yield pa.RecordBatch.from_arrays([piece.column(key), pa.array([zlib.compress((t or "").encode(), 1) for t in piece.column("text").to_pylist()], pa.binary())], names=[key, "packed"])

    return mapped(rows.select(key, "text"), run, f"{key} long, packed binary")


def unpacked(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces with the column ``raw``, the inflated bytes, instead of ``packed``."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            at = part.schema.names.index("packed")
            raw = pa.array([zlib.decompress(p) for p in part.column(at).to_pylist()], pa.binary())
            yield from pieces([part.set_column(at, "raw", raw)], "raw", limit)
