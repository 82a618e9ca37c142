"""Near-duplicate documents by circulant MinHash, with links confirmed on full sets.

A document's set holds the hashes of its distinct word shingles. Two permutations of the
32-bit universe give all coordinates of its signature: the first shuffles the elements,
the second is shifted circularly by one for each coordinate. Bands of coordinates are
buckets. Documents with equal sets form a class and only its least document goes on.

A bucket's members are compared with its least member, never with each other: sets meet
in pairs whose exact Jaccard similarity is computed, and links are closed to components.
Where a bucket still holds more than one component, the strays outside its least member's
component get further rounds: each meets the bucket's first stray, and the first of the
least member's component, in an order that differs between bands and rounds, so that it
meets many members. Every round makes at most two pairs for each row of a bucket. What is
left is settled exactly: members of buckets that still hold several components go through
a prefix-filtered set join (``unmet``), which excludes a pair of different components only
if its sets are too different for a link, and has all others verified.

A class that is the centre of very many pairs is dealt to several groups, and so are the
joins on it. No task holds more than one pair of sets. Shingles are compared as 64-bit
hashes: that two of a pair of texts of 10,000 words each collide is a case in 10**11.

Defined results: texts without words (or null) have the empty set and are linked with
nothing, not even each other; rows that repeat a doc_id are one document, which links
what any of its texts links; a row with a null doc_id is not linked and is kept, with a
null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, skew
from .components import components
from .shared import Scratch, aside, picked, tidy

#: Coordinates of a band, and bands: at similarity 0.8 a pair shares no band in 5 of a million cases.
ROWS, BANDS = 6, 40
#: Orders, by band, in which the second round looks for a bucket's first member.
ORDERS = BANDS
#: Rounds in which strays meet others of their buckets, before the exact join.
STRAY_ROUNDS = 1
#: Counters that order the exact join's shingles from rare to frequent; any order is exact, this one is fast.
COUNTERS = 1 << 18
#: Postings of one shingle that a task joins with the others' at once; more are dealt to several tasks.
POSTINGS = 4096
#: Pairs of one centre that go to the same group; more where a centre has over skew.PARTS groups.
GROUP_PAIRS = 256
#: Shingles whose coordinates are computed at once.
CHUNK = 1 << 15


def shingles(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins."""
    data, off = arrays.utf8(array)
    n = len(off) - 1
    data = arrays.LOWER_ASCII[data]
    start, end, own = arrays.words(data, off)
    word = arrays.mix(arrays.span_hash(arrays.prefix_hash(data), start, end) + (end - start).astype(np.uint64))
    m = len(word)
    words = np.bincount(own, minlength=n)
    full = max(m - width + 1, 0)
    value = word[:full].copy()
    for k in range(1, width):
        value = arrays.mix(value) + word[k : full + k]
    inside = own[:full] == own[width - 1 :] if full else np.zeros(0, bool)
    value, owner = value[inside], own[:full][inside]
    # a text of fewer words is one shingle
    first = np.searchsorted(own, np.arange(n))
    for size in range(1, width):
        short = np.flatnonzero(words == size)
        if len(short):
            one = word[first[short]]
            for k in range(1, size):
                one = arrays.mix(one) + word[first[short] + k]
            value = np.concatenate([value, arrays.mix(one + np.uint64(size))])
            owner = np.concatenate([owner, short])
    value = arrays.mix(value)
    order = np.argsort(value)
    text = owner[order].astype(np.uint16 if n <= 1 << 16 else np.uint32)
    order = order[np.argsort(text, kind="stable")]
    value, owner = value[order], owner[order]
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


_SHUFFLE = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))
_SHIFTED = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def permute(x: np.ndarray, factors: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A bijection of 32-bit values."""
    x = x * factors[0]
    x ^= x >> np.uint32(15)
    x *= factors[1]
    return x


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Coordinates of each non-empty set: shape (coordinates, sets)."""
    universe = (sets * arrays.BASE >> np.uint64(32)).astype(np.uint32)
    shuffled = permute(universe ^ universe >> np.uint32(16), _SHUFFLE)
    shuffled ^= shuffled >> np.uint32(16)
    n = len(bounds) - 1
    out = np.empty((ROWS * BANDS, n), np.uint32)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, side="right")) - 1)
        part, first = shuffled[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        for k in range(ROWS * BANDS):
            out[k, a:b] = np.minimum.reduceat(permute(part - np.uint32(k), _SHIFTED), first)
        a = b
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each set and band: shape (sets, bands)."""
    rows = signature.reshape(BANDS, ROWS, -1).astype(np.uint64)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], rows.shape[2], 1)
    for k in range(ROWS):
        key = arrays.mix(key * arrays.BASE + rows[:, k] + np.uint64(1))
    return key.T


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for salt in (0x1234567, 0x7654321):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(arrays.mix(sets + np.uint64(salt)), dtype=np.uint64)))
        out.append(arrays.mix(total[bounds[1:]] - total[bounds[:-1]] + (bounds[1:] - bounds[:-1]).astype(np.uint64)))
    return out[0], out[1]


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, and its band keys (null when empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            sets, bounds = shingles(piece.column("text"), width)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            one, two = fingerprints(sets, bounds)
            keys = band_keys(signatures(sets, np.append(bounds[:-1][some], bounds[-1]))) if len(some) else np.zeros((0, BANDS), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))), pa.int32()), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return docs.select("doc_id", "text").transform(arrays.mapped, run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def verified(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """a, b, both, either: sizes of intersection and union of pairs (a, fa, b, fb) of documents and digests."""
    dealt = skew.hot(pairs, ["a"], GROUP_PAIRS).dealt(pairs, "b")
    group = F.struct("a", "fa", "part")
    needs = dealt.select(F.col("b").alias("id"), F.col("fb").alias("f"), group.alias("g"), F.lit(1).alias("role"))
    needs = needs.unionByName(dealt.select(F.col("a").alias("id"), F.col("fa").alias("f"), group.alias("g"), F.lit(0).alias("role")).distinct())
    needs = needs.groupBy("id", "f").agg(F.collect_list(F.struct("g.a", "g.fa", "g.part", "role")).alias("roles"))
    ids = dealt.select(F.col("a").alias("id")).distinct().unionByName(dealt.select(F.col("b").alias("id")).distinct())
    wanted = arrays.IdFilter(ids, "id", 2 * pairs.count())
    texts = arrays.packed_texts(docs, "doc_id", wanted).join(needs, F.col("doc_id") == F.col("id")).select("doc_id", "f", "roles", "packed")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "fa", "part", "role", "doc", "elements"]
        for piece in arrays.unpacked(batches):
            sets, bounds = shingles(piece.column("raw"), width)
            digest = fingerprints(sets, bounds)[0].view(np.int64)
            good = digest == np.asarray(piece.column("f"))
            out: list[tuple] = []
            held = 0
            for k, (doc, roles) in enumerate(zip(piece.column("doc_id").to_pylist(), piece.column("roles").to_pylist())):
                if good[k]:
                    elements = sets[bounds[k] : bounds[k + 1]].tobytes()
                    for r in roles:
                        out.append((r["a"], r["fa"], r["part"], r["role"], doc, elements))
                        held += len(elements)
                        if held > arrays.PIECE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SETS)], names=names)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SETS)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, group = np.zeros(0, np.uint64), None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for a, fa, part, role, doc, elements in zip(*(batch.column(c).to_pylist() for c in ("a", "fa", "part", "role", "doc", "elements"))):
                mine = np.frombuffer(elements, np.uint64)
                if role == 0:
                    centre, group = mine, (a, fa, part)
                elif group == (a, fa, part):
                    at = np.searchsorted(centre, mine)
                    both = int(np.count_nonzero(centre[np.minimum(at, len(centre) - 1)] == mine))
                    found.append((a, doc, both, len(centre) + len(mine) - both))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "both", "either"])

    sets = texts.transform(arrays.mapped, emit, "a long, fa long, part long, role int, doc long, elements binary")
    placed = sets.repartition("a", "fa", "part").sortWithinPartitions("a", "fa", "part", "role")
    return placed.transform(arrays.mapped, compare, "a long, b long, both long, either long")


_SETS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())


def _slots(sets: np.ndarray) -> np.ndarray:
    return (arrays.mix(sets) & np.uint64(COUNTERS - 1)).astype(np.int64)


def postings(docs: DataFrame, members: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """e, id, root, n, pos, inside: the first shingles, rare before frequent, of each set of members (b, fb, root).

    A set of n elements that has a link with one that is not larger shares one of its first
    n - percent * n / 100 + 1 elements with it; with one that is not smaller, one of the yet
    fewer that are ``inside``.
    """
    texts = arrays.packed_texts(docs, "doc_id", arrays.IdFilter(members, "b", members.count())).join(members, F.col("doc_id") == F.col("b"))
    texts = scratch.written(texts.select("doc_id", "fb", "root", "packed"), "unsettled")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for piece in arrays.unpacked(batches):
            sets, bounds = shingles(piece.column("raw"), width)
            good = fingerprints(sets, bounds)[0].view(np.int64) == np.asarray(piece.column("fb"))
            size = np.diff(bounds)
            yield sets[np.repeat(good, size)], size[good], np.asarray(piece.column("doc_id"))[good], np.asarray(piece.column("root"))[good]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for sets, *_ in read(batches):
            total += np.bincount(_slots(sets), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counted = texts.transform(arrays.mapped, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, np.int64)
    often[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast(often)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, size, ids, roots in read(batches):
            own = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((sets, shipped.value[_slots(sets)], own))
            pos = arrays.ramps(size)
            first = size + percent * size // -100 + 1
            inside = size + 2 * percent * size // -(100 + percent) + 1
            at = np.flatnonzero(pos < first[own])
            o = own[at]
            columns = [sets[order[at]].view(np.int64), ids[o], roots[o], size[o], pos[at], pos[at] < inside[o]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["e", "id", "root", "n", "pos", "inside"])

    return scratch.written(texts.transform(arrays.mapped, emit, "e long, id long, root long, n long, pos long, inside boolean"), "postings")


def unmet(docs: DataFrame, members: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: pairs of members of different components, all links among them.

    Of a shingle's postings those of its most frequent component never meet each other; where
    one is first in common, sizes and places bound what the sets share.
    """
    found = postings(docs, members, width, percent, scratch)
    by_root = found.groupBy("e", "root").agg(F.count("*").alias("k"), F.max("inside").alias("some"))
    heads = by_root.groupBy("e").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("total"), F.count("*").alias("roots"), F.max("some").alias("some")).where("roots > 1 and some")
    heads = heads.select("e", F.col("main.root").alias("main_root"), F.ceil(F.col("total") / POSTINGS).cast("long").alias("parts"))
    live = scratch.written(found.join(heads, "e").select("e", "id", "root", "n", "pos", "inside", "parts", (F.col("root") == F.col("main_root")).alias("main")), "postings")
    dealt = live.withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    each = live.where("not main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    share = F.lit(100 + percent) * F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos")) >= F.lit(percent) * F.expr("x.n + y.n")
    ordered = F.expr(f"y.root != x.root and (y.n < x.n or (y.n = x.n and y.id < x.id)) and 100 * y.n >= {percent} * x.n")
    out = []
    for smaller, larger in ((each.where("inside"), dealt), (dealt.where("inside and main"), each)):
        met = smaller.alias("y").join(larger.alias("x"), F.expr("y.e = x.e and y.part = x.part") & ordered & share)
        out.append(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    return out[0].unionByName(out[1]).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links are pairs with 100 * intersection >= percent * union."""
    scratch, result = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    tidy(docs.sparkSession)
    docs = picked(docs, "doc_id", "text")
    sketches = scratch.written(sketch(docs, width), "sketches")
    known = sketches.where("doc_id is not null")
    linked = known.where("n_shingles > 0")
    classes = scratch.written(linked.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    members = known.select("doc_id", "n_shingles", "f1", "f2")
    members = skew.hot(members, ["f1", "f2"]).joined(members, classes, "doc_id", "left")
    members = scratch.written(members.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep")), "members")
    firsts = linked.join(classes.select("f1", "f2", F.col("rep").alias("doc_id")).hint("merge"), ["f1", "f2", "doc_id"], "left_semi")
    if firsts.count() > classes.count():  # rows repeat: one stands for its class
        firsts = firsts.dropDuplicates(["f1", "f2", "doc_id"])
    nodes = scratch.written(firsts.select(F.col("doc_id").alias("b"), F.col("f1").alias("fb"), F.col("n_shingles").alias("n")), "nodes")
    rows = firsts.select(F.posexplode("bands").alias("band", "bucket"), F.col("doc_id").alias("b")).select("bucket", "b", F.pmod("band", F.lit(ORDERS)).alias("order"))
    hubs = rows.groupBy("bucket").agg(F.min("b").alias("a"), F.count("*").alias("size")).where("size > 1").select("bucket", "a")
    shared = scratch.written(rows.join(hubs, "bucket"), "buckets")
    centres = skew.hot(shared, ["a"])

    def linking(pairs: DataFrame, centres: skew.Hot) -> DataFrame:
        """The links among pairs (a, b), whose hot centres are given."""
        other = nodes.select(F.col("b").alias("a"), F.col("fb").alias("fa"), F.col("n").alias("na"))
        similar = F.lit(100) * F.least("n", "na") >= F.lit(percent) * F.greatest("n", "na")  # else sizes rule a link out
        found = centres.joined(pairs.where("a != b").distinct().join(nodes, "b"), other, "b").where(similar)
        found = scratch.written(found.select("a", "fa", "b", "fb"), "pairs")
        is_link = F.lit(100) * F.col("both") >= F.lit(percent) * F.col("either")
        return scratch.written(verified(docs, found, width).where(is_link).select("a", "b"), "links")

    # a document with several texts ties their classes
    several = members.groupBy("doc_id").agg(F.min(F.coalesce("rep", "doc_id")).alias("low"), F.max(F.coalesce("rep", "doc_id")).alias("high")).where("low != high")
    tied = members.join(several, "doc_id").select(F.col("low").alias("a"), F.coalesce("rep", "doc_id").alias("b")).where("a != b").distinct()
    links = linking(shared.select("a", "b"), centres).unionByName(scratch.written(tied, "tied"))
    roots = components(links, scratch)

    # further rounds: strays of buckets that still hold several components
    met_before = shared.select("a", "b")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    for turn in range(STRAY_ROUNDS):
        placed = scratch.written(centres.joined(shared.join(of("b"), "b", "left"), of("a"), "b", "left"), "placed")
        stray = F.coalesce("b_root", "b") != F.coalesce("a_root", "a")
        strays = placed.where(stray).select("bucket", "order", F.col("b").alias("x"), F.coalesce("b_root", "b").alias("x_root"))
        if strays.isEmpty():
            break
        place = lambda c: F.struct(F.xxhash64(c, "order", F.lit(turn)).alias("t"), F.col(c).alias("b"))  # noqa: B023, E731
        first_main = placed.where(~stray).join(strays.select("bucket").distinct(), "bucket", "left_semi").groupBy("bucket").agg(F.min(place("b")).alias("m"))
        first_stray = strays.groupBy("bucket").agg(F.min(place("x")).alias("m"), F.min("x_root").alias("r1"), F.max("x_root").alias("r2")).where("r1 != r2")
        met = strays.select("bucket", "x").join(first_main.unionByName(first_stray.select("bucket", "m")).select("bucket", F.col("m.b").alias("y")), "bucket")
        more = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(met_before.hint("merge"), ["a", "b"], "left_anti")
        more = scratch.written(more, "met")
        met_before = met_before.unionByName(more)
        extra = linking(more, skew.hot(more, ["a"]))
        if extra.isEmpty():
            continue
        links = links.unionByName(extra)
        roots = components(links, scratch)

    # the exact rest: buckets of several components, but for those of two, whose only pair has met
    placed = shared.join(of("b"), "b", "left").select("bucket", "b", F.coalesce("b_root", "b").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("size")).where("r1 != r2 and size > 2")
    unsettled = placed.join(open_.select("bucket"), "bucket", "left_semi").select("b", "root").distinct()
    unsettled = scratch.written(unsettled.join(nodes.select("b", "fb"), "b"), "unsettled")
    if not unsettled.isEmpty():
        rest = scratch.written(unmet(docs, unsettled, width, percent, scratch).join(met_before.hint("merge"), ["a", "b"], "left_anti"), "met")
        extra = linking(rest, skew.hot(rest, ["a"]))
        if not extra.isEmpty():
            roots = components(links.unionByName(extra), scratch)
    named = members.withColumn("node", F.coalesce("rep", "doc_id"))
    out = skew.hot(named, ["node"]).joined(named, roots, "doc_id", "left").withColumn("component_id", F.coalesce("root", "node"))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = sketches.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    out = out.unionByName(nameless)
    out = result.written(out, "components")
    scratch.clear()
    return out


#: Ids that are broadcast at most (about 2 MB); beyond, they are joined.
BROADCAST_IDS = 1 << 17


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is its component's least; rows that repeat a doc_id stay together, one of each text."""
    docs, back = aside(docs, "doc_id", "text")
    decided = near_duplicates(docs, width, percent).select("doc_id", "kept")
    gone = decided.where("not kept").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if decided.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return back(kept)
    return back(kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])))
