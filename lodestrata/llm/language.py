"""Language identification by bit-sliced Bloom filters over character n-grams.

Training counts the n-grams of lower-cased letters (code points, so all scripts are
alike) per language on a sample that is bounded for each language, and keeps the most
frequent grams of each; a gram's set holds the languages in which it is about as frequent
as in its best one. A Bloom filter whose slots hold a bit for each language
stores the sets: k slots of a gram, and-ed, give all languages that contain it. A text's
language is the one with most of its grams, after each count is corrected for the false
positives that the filter's fill predicts.

Defined results: null, or no letter, is ``und`` with score 0; ties go to the smaller
language; a text without a known gram gets the most frequent language and score 0; with
nothing to learn from every text is ``und``; a null doc_id counts as the empty string in
the fold's checksum. Of labels beyond LANGUAGES the rarest are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .shared import picked

#: Training rows used at most, on average, all languages having an equal part: rows are chosen by a hash of doc_id.
TRAIN_ROWS = 24_000
#: Languages learned at most, and grams kept of all: bounds of the model.
LANGUAGES, GRAMS = 256, 1 << 17
#: Code points of a gram.
GRAM = 3
SLOTS = 1 << 19
HASHES = 3
#: A language contains a gram if its frequency there is at least this share of the best one.
NEAR = 0.25
UNKNOWN = "und"

_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled(rows: DataFrame, limit: int, n_rows: int, key: str = "doc_id") -> DataFrame:
    """About ``limit`` of the rows at most, by a hash of the key."""
    if n_rows <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(CELLS)) < cells(limit / n_rows))


#: Parts of all rows from which a sample takes some; a share of one in so many is the least.
CELLS = 1 << 52


def cells(share: float) -> int:
    """How many of CELLS a share is: never none, however large the table."""
    return max(1, int(CELLS * min(1.0, share)))


def grams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code and text of each gram of folded letters, with a space at both ends of a text; every gram holds a letter inside."""
    texts = pc.utf8_lower(pc.fill_null(array, ""))
    size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    point = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    n = len(size)
    wide = np.full(len(point) + 2 * n, 32, np.uint32)
    place = np.arange(len(point)) + 2 * np.repeat(np.arange(n), size) + 1
    wide[place] = np.where(point < 0x10000, _FOLD[np.minimum(point, 0xFFFF)], point)
    own = np.repeat(np.arange(n), size + 2)
    m = max(len(wide) - GRAM + 1, 0)
    code = np.zeros(m, np.uint64)
    for k in range(GRAM):
        code = code << np.uint64(21) | wide[k : k + m]
    inside = (own[:m] == own[GRAM - 1 :][:m]) & (wide[1 : m + 1] != 32)
    at = np.flatnonzero(inside)
    return code[at].view(np.int64), own[at]


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over (text, lang) rows, summed within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for piece in arrays.pieces(batches):
            code, own = grams(piece.column("text"))
            for lang in pc.unique(piece.column("lang")).to_pylist():
                mine = np.asarray(pc.equal(piece.column("lang"), lang))
                new, n = np.unique(code[mine[own]], return_counts=True)
                if lang in seen:
                    old, m = seen[lang]
                    both, back = np.unique(np.concatenate([old, new]), return_inverse=True)
                    seen[lang] = both, np.bincount(back, np.concatenate([m, n])).astype(np.int64)
                else:
                    seen[lang] = new, n
        for lang, (code, n) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return rows.select("text", "lang").transform(arrays.mapped, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray
    common: int

    def masks(self, code: np.ndarray) -> np.ndarray:
        """Words of language bits for each gram: shape (n, words)."""
        out = None
        for k in range(HASHES):
            found = self.slots[slot(code, k)]
            out = found if out is None else out & found
        return out


def slot(code: np.ndarray, k: int) -> np.ndarray:
    spread = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    return (spread >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def train(rows: DataFrame) -> Filters | None:
    """Filters from (doc_id, text, lang) rows; at most GRAMS rows reach the driver."""
    rows = rows.where("lang is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    per_lang = {r["lang"]: r["n"] for r in found}
    if not per_lang:
        return None
    part = TRAIN_ROWS / len(per_lang)
    shares = rows.sparkSession.createDataFrame([(k, cells(part / n)) for k, n in per_lang.items()], "lang string, share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(CELLS)) < F.col("share"))
    counts = gram_counts(chosen)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("f"))
    best = share.groupBy("gram").agg(F.max("f").alias("top"), F.max_by("lang", F.struct("f", "lang")).alias("first"), F.collect_list(F.struct("lang", "f")).alias("langs"))
    place = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("top"), "gram"))
    found = best.withColumn("place", place).where(F.col("place") <= GRAMS // len(per_lang)).select("gram", F.expr(f"transform(filter(langs, x -> x.f >= {NEAR} * top), x -> x.lang)").alias("langs")).collect()
    languages = sorted(per_lang)
    index = {x: k for k, x in enumerate(languages)}
    slots = np.zeros((SLOTS, -(-len(languages) // 64)), np.uint64)
    code = np.array([r["gram"] for r in found], np.int64)
    bits = np.zeros((len(found), slots.shape[1]), np.uint64)
    for k, r in enumerate(found):
        for lang in r["langs"]:
            bits[k, index[lang] // 64] |= np.uint64(1 << index[lang] % 64)
    for k in range(HASHES):
        np.bitwise_or.at(slots, slot(code, k), bits)
    fill = np.array([((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filters(languages, slots, fill**HASHES, index[max(sorted(per_lang), key=per_lang.get)])


PREDICTED = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """doc_id, lang_pred, score of each row of (doc_id, text)."""
    if filters is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words for each 64 of LANGUAGES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for piece in arrays.pieces(batches):
            n = piece.num_rows
            code, own = grams(piece.column("text"))
            total = np.bincount(own, minlength=n)
            found = model.masks(code)
            count = np.empty((len(model.languages), n))
            for k in range(len(model.languages)):
                hit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                count[k] = np.bincount(own, hit.astype(np.float64), minlength=n)
            p = model.false_positive[:, None]
            count = np.maximum(0, (count - total * p) / np.maximum(1 - p, 1e-9))
            best = count.argmax(0)
            top = count.max(0)
            best = np.where(top > 0, best, model.common)
            score = np.clip(top / np.maximum(total, 1), 0, 1)
            letter = np.asarray(pc.fill_null(pc.match_substring_regex(piece.column("text"), r"\pL"), False))
            names = [model.languages[b] if a else UNKNOWN for a, b in zip(letter.tolist(), best.tolist())]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").transform(arrays.mapped, run, PREDICTED)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The columns of the query: learns from the folds that are not 0, predicts every text."""
    docs = picked(docs, "doc_id", "text", "lang")
    filters = train(docs.where(fold(folds) != 0))
    return predict(docs, filters).select("doc_id", (fold(folds) == 0).alias("held_out"), "lang_pred", "score")
