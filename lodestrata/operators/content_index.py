"""A stored full-text index: postings with positions, by block of documents, in segments that never change.

A segment has one row for a term in a block of documents, with their ids, frequencies,
lengths, and the term's positions; a block's row without a term has its documents. A block's
rows are sorted by term and written where its texts were read, in one pass in which nothing
moves, so a query reads of each file the pages that hold its terms; a row's highest
frequency and least length bound what its documents can score, so that the best ones are
found without reading all blocks.

``build`` writes one segment. ``change`` adds one with the new texts and a list of the
documents that no longer count. The index's record names segments and lists; it changes by
compare-and-set, so readers see one state or the next. All scores are those of
``fulltext.bm25`` over the texts as they are by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..workers import lean
from .changes import under
from .fulltext import B, K1, ContentQuery, words
from .store import State, union

#: Documents, and words, of a block at most (a longer text is a block of its own).
BLOCK_DOCS, BLOCK_WORDS = 2048, 1 << 20
#: Bytes of the texts that a worker gets at once, about: fewer than BLOCK_DOCS of long texts.
BATCH_BYTES = 16 << 20
#: Postings rows of a file, about.
FILE_ROWS = 1 << 20
#: Blocks of the best bounds that are scored first; the k-th score found there rules others out.
SEEDS = 16

POSTINGS = "term string, block long, n int, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>, starts array<int>, positions array<int>, paths array<string>"
#: The term of the row that has a block's documents (ids, dls, paths); no word is empty.
NO_TERM = ""


def block_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """POSTINGS of (id, path_key, words) in order of ids, ``most`` documents a block: all the rows of a block come from one batch."""
    for batch in batches:
        sizes = np.asarray(batch.column("words").value_lengths())
        edge = np.maximum(np.cumsum(sizes) // BLOCK_WORDS, np.arange(len(sizes)) // most)
        cuts = [0, *(np.flatnonzero(np.diff(edge)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield from _block(batch.slice(a, b - a))


def _block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The row of the block's documents, then a row for each term, in order."""
    ids, lists = np.asarray(batch.column("id")), batch.column("words")
    dl = np.asarray(lists.value_lengths()).astype(np.int32)
    found = lists.flatten().dictionary_encode()
    ranks = pc.sort_indices(found.dictionary)
    rank = np.empty(len(ranks), np.int32)
    rank[np.asarray(ranks)] = np.arange(len(ranks), dtype=np.int32)
    code = rank[np.asarray(found.indices)]
    terms = found.dictionary.take(ranks)
    del found
    order = np.argsort(code, kind="stable")  # by term, then document, then place
    code = code[order]
    doc = np.repeat(np.arange(len(dl), dtype=np.int32), dl)[order]
    begins = (np.cumsum(dl, dtype=np.int64) - dl)[doc]
    place = (order - begins).astype(np.int32)
    del order, begins
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(code))).astype(np.int32)
    term, holder = code[at], doc[at]
    del code, doc, new
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(at) else at
    n = np.diff(np.append(first, len(at)))
    lengths = dl[holder]
    one = lambda kind: pa.array([None], pa.list_(kind))
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), values)
    block, names = int(ids[0]), ["term", "block", "n", "max_tf", "min_dl", "ids", "tfs", "dls", "starts", "positions", "paths"]
    number = lambda x: pa.array([x], pa.int32())
    documents = [pa.array([NO_TERM]), pa.array([block]), number(len(dl)), number(0), number(0), whole(pa.array(ids)), one(pa.int32()), whole(pa.array(dl)), one(pa.int32()), one(pa.int32()), whole(batch.column("path_key").cast(pa.string()))]
    yield pa.RecordBatch.from_arrays(documents, names=names)
    ends = np.append(first, len(at)).astype(np.int32)
    each = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
    reduced = lambda f, x: f.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
    starts = at - np.repeat(at[first], n)
    places = pa.ListArray.from_arrays(pa.array(np.append(at[first], len(place)).astype(np.int32)), pa.array(place))
    columns = [terms.take(pa.array(term[first])).cast(pa.string()), pa.array(np.full(len(first), block)), pa.array(n, pa.int32()), pa.array(reduced(np.maximum, tf), pa.int32()), pa.array(reduced(np.minimum, lengths), pa.int32()), each(ids[holder], pa.int64()), each(tf, pa.int32()), each(lengths, pa.int32()), each(starts, pa.int32()), places, pa.nulls(len(first), pa.list_(pa.string()))]
    yield pa.RecordBatch.from_arrays(columns, names=names)


class Index:
    """A stored index below ``place``."""

    def __init__(self, spark: SparkSession, place: str, block_docs: int = BLOCK_DOCS, seeds: int = SEEDS):
        self.spark, self.place, self.block_docs, self.seeds = spark, place, block_docs, seeds
        self.state = State(spark, f"{place}/versions")

    # ------------------------------------------------------------ writing

    def _write(self, texts: DataFrame) -> dict:
        """A new segment of (path_key, content), null contents left out; the part of the record that tells of it."""
        name = uuid.uuid4().hex
        path = f"{self.place}/segments/{name}"
        texts = texts.where("content is not null").select(F.monotonically_increasing_id().alias("id"), "path_key", words(F.col("content")).alias("words"))
        conf, rows, size = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
        before = {key: conf.get(key) for key in (rows, size)}
        most = int(before[rows])
        conf.set(rows, min(most if most > 0 else self.block_docs, self.block_docs))  # a worker holds a block's texts, not several blocks'
        conf.set(size, BATCH_BYTES)
        try:
            blocks = texts.mapInArrow(lean(partial(block_rows, most=self.block_docs)), POSTINGS)
            blocks.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/postings", compression="zstd")
        finally:
            for key, value in before.items():
                conf.set(key, value)
        held = self.spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("term") == NO_TERM)
        n, dl = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(dls, 0L, (a, x) -> a + x)")), F.lit(0))).first()
        return {"name": name, "n": n, "dl": dl}

    def build(self, texts: DataFrame) -> None:
        """The whole index of (path_key, content), in place of what was there."""
        segment = self._write(texts)
        self.state.update(lambda _: {"segments": [segment], "gone": []})

    def change(self, removed: DataFrame, upserts: DataFrame) -> bool:
        """Removes what is at or below the removed keys or is upserted, and adds upserts (path_key, content; null contents only remove).

        False, and nothing changed, where another writer has changed the index meanwhile.
        """
        version, record = self.state.read()
        keys = upserts.select("path_key").distinct()
        known = self.documents(record)
        out = under(known, removed, "left_semi").unionByName(known.join(keys, "path_key", "left_semi")).distinct()
        name = uuid.uuid4().hex
        out.select("segment", "id", "dl").write.parquet(f"{self.place}/gone/{name}")
        n, dl = self._gone([name]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        segment = self._write(upserts.dropDuplicates(["path_key"]))
        return self.state.put(version, {"segments": [*record.get("segments", []), segment], "gone": [*record.get("gone", []), {"name": name, "n": n, "dl": dl}]})

    # ------------------------------------------------------------ reading

    def _gone(self, names: list[str]) -> DataFrame:
        return union(self.spark, [f"{self.place}/gone/{n}" for n in names], "segment string, id long, dl int")

    def postings(self, record: dict | None = None) -> DataFrame:
        """segment and POSTINGS, the rows of blocks' documents among them."""
        record = self.state.read()[1] if record is None else record
        parts = [self.spark.read.schema(POSTINGS).parquet(f"{self.place}/segments/{s['name']}/postings").withColumn("segment", F.lit(s["name"])) for s in record.get("segments", [])]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{POSTINGS}, segment string")

    def _alive(self, rows: DataFrame, record: dict) -> DataFrame:
        """rows (segment, id) without documents that no longer count."""
        names = [g["name"] for g in record.get("gone", []) if g["n"]]
        return rows.join(self._gone(names).select("segment", "id"), ["segment", "id"], "left_anti") if names else rows

    def documents(self, record: dict | None = None) -> DataFrame:
        """segment, id, path_key, dl of the documents that count."""
        record = self.state.read()[1] if record is None else record
        each = self.postings(record).where(F.col("term") == NO_TERM).select("segment", F.explode(F.arrays_zip("ids", "paths", "dls")).alias("d"))
        return self._alive(each.select("segment", F.col("d.ids").alias("id"), F.col("d.paths").alias("path_key"), F.col("d.dls").alias("dl")), record)

    def frequencies(self) -> DataFrame:
        """term, df, n (occurrences) over the documents that count."""
        record = self.state.read()[1]
        rows = self.postings(record).where(F.col("term") != NO_TERM)
        if not any(g["n"] for g in record.get("gone", [])):
            return rows.select("term", "n", F.expr("aggregate(tfs, 0L, (a, x) -> a + x)").alias("m")).groupBy("term").agg(F.sum("n").alias("df"), F.sum("m").alias("n"))
        each = rows.select("segment", "term", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("segment", F.col("p.ids").alias("id"), "term", F.col("p.tfs").alias("tf"))
        return self._alive(each, record).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))

    def top(self, query: ContentQuery, k: int, only: DataFrame | None = None) -> DataFrame:
        """path_key, score of the k best documents, by falling score and path; ``only`` (path_key) restricts the hits, not the statistics."""
        record = self.state.read()[1]
        terms = list(dict.fromkeys(w for c in query.clauses for w in c))
        rows = self.postings(record).where(F.col("term").isin(*terms))
        counts = {r["term"]: r["df"] for r in self._frequencies_of(rows, record).collect()}
        n = sum(s["n"] for s in record.get("segments", [])) - sum(g["n"] for g in record.get("gone", []))
        average = (sum(s["dl"] for s in record.get("segments", [])) - sum(g["dl"] for g in record.get("gone", []))) / max(n, 1) or 1.0
        idf = {w: float(np.log(1 + (n - counts.get(w, 0) + 0.5) / (counts.get(w, 0) + 0.5))) for w in terms}
        chosen = None if only is None else self.documents(record).join(only.select("path_key").distinct(), "path_key", "left_semi").select("segment", "id")

        def best(blocks: DataFrame | None) -> DataFrame:
            some = rows if blocks is None else rows.join(blocks, ["segment", "block"], "left_semi")
            hits = self._alive(_hits(some, query, idf, average), record)
            return (hits if chosen is None else hits.join(chosen, ["segment", "id"], "left_semi")).select("segment", "id", "score")

        bounds = self._bounds(rows, query, idf, average)
        seeds = bounds.orderBy(F.desc("bound"), "segment", "block").limit(self.seeds + 1).collect()
        found = None
        if len(seeds) > self.seeds:
            first = self.spark.createDataFrame([(r["segment"], r["block"]) for r in seeds[: self.seeds]], "segment string, block long")
            scores = [r["score"] for r in best(F.broadcast(first)).orderBy(F.desc("score")).limit(k).collect()]
            if len(scores) == k:  # scores are rounded: a bound may be that much below one
                found = best(bounds.where(F.col("bound") >= scores[-1] - 1e-6).select("segment", "block")).where(F.col("score") >= scores[-1])
        found = best(None) if found is None else found
        return found.join(self.documents(record).select("segment", "id", "path_key"), ["segment", "id"]).orderBy(F.desc("score"), "path_key").limit(k).select("path_key", "score")

    def _frequencies_of(self, rows: DataFrame, record: dict) -> DataFrame:
        if not any(g["n"] for g in record.get("gone", [])):
            return rows.groupBy("term").agg(F.sum("n").alias("df"))
        each = rows.select("segment", "term", F.explode("ids").alias("id"))
        return self._alive(each, record).groupBy("term").agg(F.count("*").alias("df"))

    @staticmethod
    def _bounds(rows: DataFrame, query: ContentQuery, idf: dict[str, float], average: float) -> DataFrame:
        """segment, block, bound: no document of the block scores more; blocks without any clause are left out."""
        some = sorted({w for c in query.positive for w in c})
        stats = rows.groupBy("segment", "block").agg(*(f(F.when(F.col("term") == w, F.col(c))).alias(f"{c}{k}") for k, w in enumerate(some) for f, c in ((F.max, "max_tf"), (F.min, "min_dl"))))

        def bound(clause: tuple[str, ...]) -> Column:
            at = [some.index(w) for w in clause]
            tf = reduce(lambda a, b: F.least(a, b), (F.coalesce(f"max_tf{k}", F.lit(0)) for k in at)) if len(at) > 1 else F.coalesce(f"max_tf{at[0]}", F.lit(0))
            dl = F.coalesce(f"min_dl{at[0]}", F.lit(0))
            return sum(idf[w] for w in clause) * _weight(tf, dl, average)

        total = reduce(lambda a, b: a + b, map(bound, query.positive))
        return stats.select("segment", "block", total.alias("bound")).where("bound > 0")


def _weight(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def _hits(rows: DataFrame, query: ContentQuery, idf: dict[str, float], average: float) -> DataFrame:
    """segment, id, score of the documents that the query finds."""
    terms = sorted({w for c in query.clauses for w in c})
    phrased = sorted({w for c in query.clauses if len(c) > 1 for w in c})
    columns = ["ids", "tfs", "dls", *(["starts"] if phrased else [])]
    each = rows.select("segment", "term", F.explode(F.arrays_zip(*columns)).alias("p"), *(["positions"] if phrased else []))
    places = F.when(F.col("term").isin(*phrased), F.slice("positions", F.col("p.starts") + 1, F.col("p.tfs"))) if phrased else None
    each = each.select("segment", F.col("p.ids").alias("id"), "term", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), *([places.alias("places")] if phrased else []))
    docs = each.groupBy("segment", "id").agg(F.max("dl").alias("dl"), *(F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"t{k}") for k, w in enumerate(terms)), *(F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{k}") for k, w in enumerate(terms) if w in phrased))

    def times(clause: tuple[str, ...]) -> Column:
        at = [terms.index(w) for w in clause]
        if len(at) == 1:
            return F.col(f"t{at[0]}")
        begun = [F.transform(F.col(f"p{k}"), partial(lambda j, x: x - j, j)) for j, k in enumerate(at)]
        return F.coalesce(F.size(reduce(F.array_intersect, begun)), F.lit(0))

    docs = docs.select("segment", "id", "dl", *(times(c).alias(f"c{k}") for k, c in enumerate(query.clauses)))
    tf = {c: F.col(f"c{k}") for k, c in enumerate(query.clauses)}
    weights = {c: F.lit(sum(idf[w] for w in c)) * _weight(tf[c], F.col("dl"), average) for c in query.positive}
    return docs.where(query.holds(tf)).select("segment", "id", F.round(query.score(weights, tf), 6).alias("score"))
