"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes covers it that also starts earlier (a smaller
doc_id, or the same document and an earlier start), judged on the input.

Copies of a whole text are found first, by digest. For the rest, every string (window) of
``length`` bytes owns an anchor: the leftmost of its grams of GRAM bytes with the least
hash. Equal windows own equal anchors at equal places, so only windows whose anchor's
gram occurs again can be repeated; the windows that own one anchor are neighbours, a run
that a segment of at most 2 * length bytes holds. The work is then:

1. Grams: each task sends the hashes of its anchors to buckets, which tell the ones that
   occur again. A hash that is frequent within a few megabytes is sent once and called
   famous, like one that is frequent over all. On large tables the most frequent hashes of
   a sample are told to all tasks and called famous at once; so they fill no bucket.
2. Segments: documents with repeated anchors send these anchors' segments, equal ones
   of a few megabytes once. The windows of famous grams are sent one by one under their
   own hash instead, again once.
3. Suffix sort: a group's segments are sorted by mergesort whose comparisons find the
   common extension by binary search over prefix polynomial hashes; equal neighbours are
   verified byte by byte. Only the first of equal segments can stay. The windows of the
   remaining ones are sorted the same way, and all but the first of equal windows go. A
   famous window's occurrences are dealt to several tasks, each of which compares them one
   after the other and passes its first on to a second round.
4. The removed runs return to their documents.

Defined results: a null text is empty; rows with equal doc_id are ordered by a hash of
their text, and rows alike in both count as one document; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, skew
from .shared import Scratch, aside, count_partitions, picked, tidy, written

LENGTH = 100
#: Bytes of a gram.
GRAM = 32
#: Anchors for which a bucket is made, on average.
BUCKET_ANCHORS = 150_000
#: Text bytes within which strings are told apart before they are sent.
NEAR_BYTES = 1 << 18
#: Occurrences, over all and within NEAR_BYTES, from which on a gram is famous.
FAMOUS, FAMOUS_HERE = 1 << 16, 1 << 10
#: Text bytes from which on the most frequent grams are looked for first, in one of so many documents.
SAMPLED_BYTES, SAMPLED = 8 << 30, 64
#: Frequent grams that are told to all tasks at most (half a megabyte).
HOT_GRAMS = 1 << 16
#: Text bytes whose segments one task sorts, on average.
TASK_BYTES = 32 << 20
#: Segment bytes that are sorted together.
SORT_BYTES = 1 << 18
#: Segments whose bytes are gathered, or compared, at once.
SENT_ROWS = 1 << 12
#: Bytes whose anchors are found at once: an array of 8 bytes each stays below workers.RETURNED_BYTES, else every step maps its memory anew.
BLOCK = 1 << 13
NULL_ID = -(1 << 63)


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and gram hash of every anchor, and the first and last window that own it.

    A window is named by its first byte. Windows never cross texts. Bytes are taken in
    blocks, so that memory doesn't grow with a text.
    """
    parts = []
    for a in range(0, max(len(data) - length + 1, 0), BLOCK):
        position, value, first, last = _block_anchors(data[a : a + BLOCK + length - 1], off, a, length)
        if parts and len(position) and parts[-1][0][-1] == position[0] and parts[-1][3][-1] == first[0] - 1:
            parts[-1][3][-1] = last[0]  # a run that goes on from the block before
            position, value, first, last = position[1:], value[1:], first[1:], last[1:]
        if len(position):
            parts.append((position, value, first, last))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_anchors(data: np.ndarray, off: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, reach = len(data), length - GRAM + 1
    prefix = arrays.prefix_hash(data)
    _, down = arrays.powers(n + 1)
    value = arrays.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    # least value and its leftmost place over windows of 1, 2, 4, ... grams, then of ``reach``
    low, place, width = value, np.arange(len(value), dtype=np.int32), 1
    while 2 * width <= reach:
        low, place = _lower(low[:-width], place[:-width], low[width:], place[width:])
        width *= 2
    rest = reach - width
    if rest:
        low, place = _lower(low[:-rest], place[:-rest], low[rest:], place[rest:])
    starts = np.arange(base, base + n - length + 1)
    good = starts + length <= off[1:][np.minimum(arrays.owner(off, starts), len(off) - 2)]
    starts, place = starts[good], place[: n - length + 1][good]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    position = place[first].astype(np.int64)
    return position + base, value[position], starts[first], starts[last]


def _lower(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    take = b < a
    return np.minimum(a, b), np.where(take, pb, pa_)


# ---------------------------------------------------------------- suffix sort


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes a and b, up to ``limit``: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), limit.astype(np.int64).copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        equal = arrays.span_hash(prefix, a, a + middle) == arrays.span_hash(prefix, b, b + middle)
        low = np.where(open_ & equal, middle, low)
        high = np.where(open_ & ~equal, middle - 1, high)


def precedes(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
    """Whether suffix x stands before y: by bytes, then by length, then by ``or_equal``."""
    limit = np.minimum(size[x], size[y])
    same = common(prefix, start[x], start[y], limit)
    ended = same >= limit
    place = np.minimum(same, np.maximum(limit - 1, 0))
    less = data[start[x] + place] < data[start[y] + place]
    return np.where(ended, np.where(size[x] == size[y], or_equal, size[x] < size[y]), less)


def suffix_order(data: np.ndarray, prefix: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the suffixes data[start:start+size] inside their groups (``group`` ascends): a stable bottom-up mergesort.

    All pairs of runs of all groups are merged at once: the new place of a suffix is its
    place in its own run plus its rank in the other, found by binary search with
    hash-compared suffixes.
    """
    order = np.arange(len(start))
    first, length = arrays.runs(group)
    g_first, g_length = np.repeat(first, length), np.repeat(length, length)
    local = np.arange(len(start)) - g_first
    width = 1
    while len(length) and width < length.max():
        active = np.flatnonzero(g_length > width)
        here = local[active]
        block = here // (2 * width) * (2 * width)
        right = here - block >= width
        other = np.where(right, block, block + width)
        other_size = np.clip(np.where(right, width, g_length[active] - other), 0, width)
        item = order[active]
        low, high = np.zeros(len(active), np.int64), other_size.astype(np.int64)
        base = g_first[active] + other
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            middle = (low[todo] + high[todo]) >> 1
            against = order[base[todo] + middle]
            # equal ones: those of the left run first
            before = precedes(data, prefix, start, size, against, item[todo], right[todo])
            low[todo] = np.where(before, middle + 1, low[todo])
            high[todo] = np.where(before, high[todo], middle)
        moved = g_first[active] + block + (here - block - np.where(right, width, 0)) + low
        new = order.copy()
        new[moved] = item
        order = new
        width *= 2
    return order


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] is data[b:b+n], for each of the (positive) n."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), SENT_ROWS):
        size = n[k : k + SENT_ROWS]
        step = arrays.ramps(size)
        differ = data[np.repeat(a[k : k + SENT_ROWS], size) + step] != data[np.repeat(b[k : k + SENT_ROWS], size) + step]
        out[k : k + SENT_ROWS] = np.add.reduceat(differ, np.cumsum(size) - size, dtype=np.int64) == 0
    return out


def classes(data: np.ndarray, prefix: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each suffix the first (in given order) suffix of its group with the same bytes.

    Neighbours in the sorted order are compared by hash and then byte by byte; a collision
    of hashes splits the class.
    """
    order = suffix_order(data, prefix, group, start, size)
    if not len(order):
        return order
    x, y = order[:-1], order[1:]
    same = (group[x] == group[y]) & (size[x] == size[y])
    at = np.flatnonzero(same)
    same[at] = arrays.span_hash(prefix, start[x[at]], start[x[at]] + size[x[at]]) == arrays.span_hash(prefix, start[y[at]], start[y[at]] + size[y[at]])
    at = np.flatnonzero(same)
    same[at] = equal_bytes(data, start[x[at]], start[y[at]], size[x[at]])
    head = np.concatenate(([True], ~same))
    run = np.cumsum(head) - 1
    least = np.minimum.reduceat(order, np.flatnonzero(head))
    out = np.empty(len(order), np.int64)
    out[order] = least[run]
    return out


# ---------------------------------------------------------------- the steps


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive slices of the bytes."""
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_GRAMS = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("fame", pa.binary())])
_ANSWERS = pa.schema([("id", pa.int64()), ("places", pa.binary()), ("famous", pa.binary())])
_SPANS = pa.schema([("id", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])
_GRAM_TYPES = "bucket long, hashes binary, docs binary, sizes binary, places binary, fame binary"


def frequent_grams(rows: DataFrame, length: int, sampled: int, least: int) -> np.ndarray:
    """Sorted hashes of the most frequent grams of one in ``sampled`` documents, of ``least`` occurrences there or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches, limit=NEAR_BYTES):
            data, off = arrays.utf8(piece.column("text"))
            value, count = np.unique(anchors(data, off, length)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["gram", "n"])

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(sampled)) == 0).select("text")
    found = some.transform(arrays.mapped, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = found.orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).collect()
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(np.uint64))


def gram_rows(rows: DataFrame, length: int, buckets: int, here: int = FAMOUS_HERE, hot: np.ndarray | None = None) -> DataFrame:
    """Step 1, in each task: for each bucket the hashes of anchors and where they stand.

    hashes: 6 bytes each; docs and sizes: ids and how many anchors of each follow; places:
    numbers of the anchors in their documents; fame: occurrences within the piece. A row
    without a bucket tells a document's anchors that are famous already, as all of ``hot`` are.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if hot is None else hot)  # HOT_GRAMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches, limit=NEAR_BYTES):
            data, off = arrays.utf8(piece.column("text"))
            position, value, _, _ = anchors(data, off, length)
            own = arrays.owner(off, position)
            number = np.arange(len(own)) - np.searchsorted(own, own)
            order = np.argsort(value, kind="stable")
            first, count = arrays.runs(value[order])
            fame = np.empty(len(value), np.int64)
            fame[order] = np.repeat(count, count)
            ids = piece.column("id").to_numpy()
            out: list[tuple] = []
            told = np.isin(value, shipped.value)
            famous = np.flatnonzero(told | (fame >= here))
            for a, n in zip(*(x.tolist() for x in arrays.runs(own[famous]))):
                part = famous[a : a + n]
                out.append((None, None, ids[own[part[:1]]].tobytes(), None, number[part].astype(np.int32).tobytes(), None))
            sent = fame < here
            sent[order[first]] = True
            sent = np.flatnonzero(sent & ~told)
            # anchors are least hashes: mixed again, they fall into all buckets alike
            spread = arrays.mix(value[sent] ^ arrays.BASE)
            bucket = (spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            by = np.lexsort((ids[own[sent]], bucket))
            sent, bucket = sent[by], bucket[by]
            low = spread[by].view(np.uint8).reshape(-1, 8)[:, :6]
            near, few = number[sent].astype(np.int32), np.minimum(fame[sent], here).astype(np.uint16)
            for a, n in zip(*(x.tolist() for x in arrays.runs(bucket))):
                part = slice(a, a + n)
                heads, sizes = arrays.runs(own[sent[part]])
                out.append((int(bucket[a]), low[part].tobytes(), ids[own[sent[part]][heads]].tobytes(), sizes.astype(np.int32).tobytes(), near[part].tobytes(), few[part].tobytes()))
            for a in range(0, len(out), 2048):
                yield _batch(out[a : a + 2048], _GRAMS)

    return rows.select("id", "text").transform(arrays.mapped, run, _GRAM_TYPES)


def repeated_anchors(grams: DataFrame, buckets: int, over_all: int = FAMOUS, here: int = FAMOUS_HERE) -> DataFrame:
    """id, places, famous (a byte each): anchors whose gram occurs again anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, places, fames = [], [], [], []
        for batch in batches:
            known: list[tuple] = []
            for bucket, h, d, s, p, f in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if bucket is None:
                    known.append((int(np.frombuffer(d, np.int64)[0]), p, b"\1" * (len(p) // 4)))
                    continue
                low = np.zeros((len(h) // 6, 8), np.uint8)
                low[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
                hashes.append(low.view(np.uint64)[:, 0] ^ np.uint64(bucket << 48 & (1 << 64) - 1))
                owners.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(s, np.int32)))
                places.append(np.frombuffer(p, np.int32))
                fames.append(np.frombuffer(f, np.uint16))
            if known:
                yield _batch(known, _ANSWERS)
        if not hashes:
            return
        value, owner, place, fame = map(np.concatenate, (hashes, owners, places, fames))
        hashes, owners, places, fames = [], [], [], []
        order = np.argsort(value, kind="stable")
        first, count = arrays.runs(value[order])
        most = np.maximum.reduceat(fame[order], first)
        famous = np.repeat((most >= here) | (count >= over_all), count)
        some = np.repeat((count > 1) | (most >= here), count)
        at, famous = order[some], famous[some]
        by = np.argsort(owner[at], kind="stable")
        at, famous = at[by], famous[by].astype(np.uint8)
        edges = np.append(arrays.runs(owner[at])[0], len(at)).tolist()
        for x in range(0, len(edges) - 1, 4096):
            part = edges[x : x + 4097]
            yield _batch([(int(owner[at[a]]), place[at[a:b]].tobytes(), famous[a:b].tobytes()) for a, b in zip(part, part[1:])], _ANSWERS)

    return grams.repartition(buckets, F.coalesce("bucket", F.xxhash64("docs"))).transform(arrays.mapped, run, "id long, places binary, famous binary")


def segments(marked: DataFrame, length: int) -> DataFrame:
    """Step 2: key, id, start, windows, bytes of the marked anchors' segments; without key and bytes, runs that go already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.unpacked(batches, NEAR_BYTES):
            piece = piece.take(pa.compute.sort_indices(piece.column("id")))
            data, off = arrays.utf8(piece.column("raw"))
            prefix = arrays.prefix_hash(data)
            position, value, low, high = anchors(data, off, length)
            begin = np.searchsorted(arrays.owner(off, position), np.arange(piece.num_rows))
            chosen, flags = [], []
            for k, (places, famous) in enumerate(zip(piece.column("places").to_pylist(), piece.column("famous").to_pylist())):
                chosen.append(begin[k] + np.frombuffer(b"".join(places), np.int32))
                flags.append(np.frombuffer(b"".join(famous), np.uint8))
            at, back = np.unique(np.concatenate(chosen), return_inverse=True)
            famous = np.bincount(back, np.concatenate(flags), minlength=len(at)) > 0
            few, many = at[~famous], at[famous]
            n = high[many] - low[many] + 1
            single = np.repeat(low[many], n) + arrays.ramps(n)
            start = np.concatenate([low[few], single])
            windows = np.concatenate([high[few] - low[few] + 1, np.ones(len(single), np.int64)])
            # grams' keys are odd, windows' even
            key = np.concatenate([value[few] | np.uint64(1), arrays.mix(arrays.span_hash(prefix, single, single + length)) & ~np.uint64(1)])
            size = windows + length - 1
            by = np.argsort(start, kind="stable")
            start, windows, key, size = start[by], windows[by], key[by], size[by]
            whole = arrays.mix(arrays.span_hash(prefix, start, start + size) + size.astype(np.uint64)) ^ key
            order = np.argsort(whole, kind="stable")
            heads, count = arrays.runs(whole[order])
            first = np.empty(len(order), np.int64)
            first[order] = np.repeat(order[heads], count)
            again = np.flatnonzero(first != np.arange(len(first)))
            again = again[equal_bytes(data, start[first[again]], start[again], size[again])]
            sent = np.ones(len(start), bool)
            sent[again] = False
            text = arrays.owner(off, start)
            ids, place = piece.column("id").to_numpy()[text], (start - off[text]).astype(np.int32)
            keys = key.view(np.int64)
            names = ["key", "id", "start", "windows", "bytes"]
            for a in range(0, len(again), 50_000):
                k = again[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.array(ids[k]), pa.array(place[k]), pa.array(windows[k].astype(np.int32)), pa.nulls(len(k), pa.binary())], names=names)
            sent = np.flatnonzero(sent)
            for a in range(0, len(sent), SENT_ROWS):
                k = sent[a : a + SENT_ROWS]
                raw = data[np.repeat(start[k], size[k]) + arrays.ramps(size[k])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[k]), pa.array(ids[k]), pa.array(place[k]), pa.array(windows[k].astype(np.int32)), _binary(raw, size[k])], names=names)

    return marked.transform(arrays.mapped, run, "key long, id long, start int, windows int, bytes binary")


def resolve(key: np.ndarray, windows: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Step 3: which windows of the segments go, as (segment, offset in it). Segments come by key, then in the order of their documents."""
    size = windows + length - 1
    start = np.cumsum(size) - size
    prefix = arrays.prefix_hash(data)
    _, counts = arrays.runs(key)
    group = np.repeat(np.arange(len(counts)), counts)
    first = classes(data, prefix, group, start, size)
    own = first == np.arange(len(first))
    later = np.flatnonzero(~own)
    # windows of the different segments of a gram
    heads = np.flatnonzero(own & (np.bincount(group[own], minlength=len(counts))[group] > 1))
    segment, step = np.repeat(heads, windows[heads]), arrays.ramps(windows[heads])
    at = start[segment] + step
    word = arrays.mix(arrays.span_hash(prefix, at, at + length)) ^ arrays.mix(group[segment].astype(np.uint64))
    order = np.argsort(word, kind="stable")
    _, count = arrays.runs(word[order])
    some = np.repeat(count > 1, count)
    pick, sub = order[some], np.repeat(np.arange(len(count)), count)[some]
    same = classes(data, prefix, sub, at[pick], np.full(len(pick), length))
    late = pick[same != np.arange(len(pick))]
    return np.concatenate([np.repeat(later, windows[later]), segment[late]]), np.concatenate([arrays.ramps(windows[later]), step[late]])


def _spans(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Merged runs, a row for each document."""
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable")
    ids, start, end = ids[order], start[order], end[order]
    edges = np.append(arrays.runs(ids)[0], len(ids)).tolist()
    for x in range(0, len(edges) - 1, 4096):
        part = edges[x : x + 4097]
        yield _batch([(int(ids[a]), *(s.astype(np.int64).tobytes() for s in _merged(start[a:b], end[a:b]))) for a, b in zip(part, part[1:])], _SPANS)


class FirstWindows:
    """Tells the first of equal windows, which come by key and in order; holds one key's different windows."""

    def __init__(self) -> None:
        self.key: int | None = None
        self.seen: set[bytes] = set()

    def later(self, keys: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Whether each window (a row of bytes) is the same as one before."""
        first, count = arrays.runs(keys)
        head = np.repeat(first, count)
        same = (windows == windows[head]).all(1)
        out = same & (np.arange(len(keys)) != head)
        # a key that goes on from the batch before, and unlike windows of one key
        slow = set(np.unique(head[~same]).tolist())
        if len(keys) and keys[0] == self.key:
            slow.add(0)
        for a in sorted(slow):
            if keys[a] != self.key:
                self.key, self.seen = int(keys[a]), set()
            for k in range(a, a + int(count[np.searchsorted(first, a)])):
                raw = windows[k].tobytes()
                out[k] = raw in self.seen
                self.seen.add(raw)
        if len(keys) and keys[-1] != self.key:
            self.key, self.seen = int(keys[-1]), {windows[head[-1]].tobytes()}
        return out


_FOUND = pa.schema([*_SPANS, ("key", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())])
_FOUND_TYPES = "id long, starts binary, ends binary, key long, start int, bytes binary"


def removed(found: DataFrame, length: int, total: int, scratch: Scratch) -> DataFrame:
    """id, starts, ends of removed runs, several rows for a document; ``total``: all text bytes."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        data, _ = arrays.utf8(table.column("bytes"))
        segment, offset = resolve(table.column("key").to_numpy(), table.column("windows").to_numpy().astype(np.int64), data, length)
        start = table.column("start").to_numpy().astype(np.int64)[segment] + offset
        yield from _spans(table.column("id").to_numpy()[segment], start, start + length)

    def wide(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, f.type) for f in list(_FOUND)[3:])], schema=_FOUND)

    def famous_windows(batch: pa.RecordBatch, firsts: FirstWindows, last: bool) -> Iterator[pa.RecordBatch]:
        data, _ = arrays.utf8(batch.column("bytes"))
        late = firsts.later(batch.column("key").to_numpy(), data.reshape(-1, length))
        start = batch.column("start").to_numpy().astype(np.int64)[late]
        yield from wide(_spans(batch.column("id").to_numpy()[late], start, start + length))
        stays = batch.filter(pa.array(~late))
        if stays.num_rows and not last:
            none = pa.nulls(stays.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([stays.column("id"), none, none, *(stays.column(c) for c in ("key", "start", "bytes"))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last_key, firsts = 0, None, FirstWindows()
        for batch in batches:
            known = pa.compute.is_null(batch.column("key"))
            ready = batch.filter(known)
            if ready.num_rows:
                start = ready.column("start").to_numpy().astype(np.int64)
                yield from wide(_spans(ready.column("id").to_numpy(), start, start + ready.column("windows").to_numpy() + length - 1))
            batch = batch.filter(pa.compute.invert(known))
            even = batch.column("key").to_numpy() & 1 == 0
            if even.any():
                yield from famous_windows(batch.filter(pa.array(even)), firsts, False)
                batch = batch.filter(pa.array(~even))
            if not batch.num_rows:
                continue
            # what is sorted together ends where the key changes
            key = batch.column("key").to_numpy()
            cuts = arrays.runs(key)[0]
            if key[0] == last_key:
                cuts = cuts[1:]
            last_key = key[-1]
            before = np.concatenate(([0], np.cumsum(pa.compute.binary_length(batch.column("bytes")).to_numpy(), dtype=np.int64)))
            a = 0
            while True:
                k = np.searchsorted(before[cuts], before[a] + SORT_BYTES - size)
                while k < len(cuts) and cuts[k] < a:
                    k += 1
                if k >= len(cuts):
                    held.append(batch.slice(a))
                    size += int(before[-1] - before[a])
                    break
                if cuts[k] > a:
                    held.append(batch.slice(a, int(cuts[k]) - a))
                if held:
                    yield from wide(solve(held))
                a, held, size = int(cuts[k]), [], 0
                cuts = cuts[k + 1 :]
        if held:
            yield from wide(solve(held))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = FirstWindows()
        for batch in batches:
            if batch.num_rows:
                for rows in famous_windows(batch, firsts, True):
                    yield rows.select(_SPANS.names)

    spark = found.sparkSession
    parts = count_partitions(spark, total, TASK_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a famous window is sent once for each NEAR_BYTES: as many tasks take them as rows go to one
    salts = max(1, int((total / NEAR_BYTES) ** 0.5))
    place = F.when(F.col("key").isNull(), F.xxhash64("id", "start")).when(F.col("key").bitwiseAND(1) == 1, F.xxhash64("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("id"), F.lit(salts))))
    first = found.repartition(parts, place).sortWithinPartitions("key", "id", "start").transform(arrays.mapped, run, _FOUND_TYPES)
    first = scratch.written(first, "removed")
    windows = first.where("key is not null").select("key", "id", "start", "bytes")
    late = windows.repartition(parts, "key").sortWithinPartitions("key", "id", "start").transform(arrays.mapped, second, "id long, starts binary, ends binary")
    return first.where("key is null").select("id", "starts", "ends").unionByName(late)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with ``id``, unlike for unlike rows and in their order; whether ids had to be made.

    Where doc_id is unique it is the id. Else rows are numbered in the order of (doc_id,
    hash of the text), alike rows once.
    """
    rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows, False
    keys = rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("ident")).distinct()
    parts = docs.sparkSession.sparkContext.defaultParallelism
    keys = keys.repartitionByRange(parts, "id", "ident").sortWithinPartitions("id", "ident")
    keys = written(keys.select(F.col("id").alias("k"), "ident", F.monotonically_increasing_id().alias("new")), "numbers")
    rows = rows.join(keys, (F.col("id") == F.col("k")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("ident")))
    return rows.withColumn("id", F.col("new")).drop("k", "ident", "new"), True


def repeated_spans(rows: DataFrame, scratch: Scratch, length: int = LENGTH, doubled: bool = False, famous: tuple[int, int] = (FAMOUS, FAMOUS_HERE), sampled_bytes: int = SAMPLED_BYTES, sampled: int = SAMPLED) -> DataFrame:
    """id, copy (the whole text stands earlier), starts, ends (lists of int64 arrays) of documents that lose something."""
    tidy(rows.sparkSession)
    texts = rows.select("id", "text").where(F.octet_length("text") >= length)
    if doubled:
        texts = texts.dropDuplicates(["id"])
    ids = scratch.written(texts.select("id", F.md5("text").alias("digest"), F.octet_length("text").alias("n")), "ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    first = ids.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    copies = scratch.written(skew.hot(ids, ["digest", "n"]).joined(ids, first, "id").where("id != first").select("id"), "copies")
    hot = frequent_grams(texts, length, sampled, max(2, famous[0] // sampled)) if total >= sampled_bytes else None
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, int(2 * total / (length - GRAM + 2) / BUCKET_ANCHORS) + 1)
    answers = repeated_anchors(gram_rows(texts, length, buckets, famous[1], hot), buckets, *famous)
    told = answers.groupBy("id").agg(F.collect_list("places").alias("places"), F.collect_list("famous").alias("famous")).join(copies, "id", "left_anti")
    marked = arrays.packed_texts(texts).join(told, "id").select("id", "packed", "places", "famous")
    spans = removed(segments(marked, length), length, total, scratch)
    spans = spans.groupBy("id").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")).withColumn("copy", F.lit(False))
    none = F.array().cast("array<binary>")
    return spans.unionByName(copies.select("id", none.alias("starts"), none.alias("ends"), F.lit(True).alias("copy")))


def _cut(size: int, copy: bool | None, starts: list | None, ends: list | None) -> tuple[np.ndarray, np.ndarray]:
    if copy:
        return np.array([0]), np.array([size])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _merged(np.frombuffer(b"".join(starts), np.int64), np.frombuffer(b"".join(ends), np.int64))


def _left(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))


def report(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows, doubled = numbered(picked(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    scratch = Scratch(docs.sparkSession)
    spans = written(repeated_spans(rows, scratch, length, doubled, **options), "spans")
    scratch.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for piece in arrays.unpacked(batches):
            out = []
            for doc, raw, copy, starts, ends in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "raw", "copy", "starts", "ends"))):
                a, b = _cut(len(raw), copy, starts, ends)
                out.append((doc, len(raw), int((b - a).sum()), len(a), hashlib.sha256(_left(raw, a, b)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    packed = arrays.packed_texts(rows)
    if doubled:
        packed = packed.withColumnRenamed("id", "new").join(rows.select(F.col("id").alias("new"), "doc_id").distinct(), "new").withColumnRenamed("new", "id")
    else:
        packed = packed.withColumn("doc_id", F.when(F.col("id") != NULL_ID, F.col("id")))
    joined = packed.join(spans, "id", "left").select("doc_id", "packed", "copy", "starts", "ends")
    return joined.transform(arrays.mapped, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs without repeated strings; a character goes only with all its bytes, and texts left empty stay as empty texts."""
    plain, back = aside(docs, "doc_id", "text")
    columns = plain.columns
    rows, doubled = numbered(plain)
    scratch = Scratch(docs.sparkSession)
    spans = written(repeated_spans(rows.select("id", F.coalesce("text", F.lit("")).alias("text")), scratch, length, doubled), "spans")
    scratch.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            texts = []
            for text, copy, starts, ends in zip(*(piece.column(c).to_pylist() for c in ("text", "copy", "starts", "ends"))):
                if text is not None and (copy or starts):
                    raw = text.encode()
                    start, end = (x.copy() for x in _cut(len(raw), copy, starts, ends))
                    for k in range(len(start)):
                        while start[k] < end[k] and raw[start[k]] & 0xC0 == 0x80:
                            start[k] += 1
                        while start[k] < end[k] < len(raw) and raw[end[k]] & 0xC0 == 0x80:
                            end[k] -= 1
                    text = _left(raw, start, end).decode()
                texts.append(text)
            at = piece.schema.names.index("text")
            yield piece.set_column(at, "text", pa.array(texts, pa.string())).select(columns)

    joined = rows.join(spans, "id", "left").select(*columns, "copy", "starts", "ends")
    return back(joined.transform(arrays.mapped, run, plain.schema))
