"""Quality rules: base counts of a text, and cross-document line frequency.

Base counts come from whole texts: words are runs without ASCII white space; see
``measure``. The method's verdict works on lines. A line is normalised (lower case, runs
of white space as one space, digits as 0) and hashed; for each host (``source``) the
distinct documents that hold it are counted. Copies are no evidence of boilerplate, so
documents of the same whole text count as one, here and in the host's total. Lines in more
documents than the host's limit are removed; a document is rejected if less than a tenth of its words is
left.

Counting is in two steps, first over (host, line, text), so that Spark sums
partly before each shuffle and no key's rows need to meet in one task.

Defined results: null text has no words, fails the base rule and is not kept; a null
source is a host of its own; rows that repeat a doc_id are judged each by its own text;
lines without a word are never counted or removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, skew
from .shared import Scratch, aside, picked

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
#: A line is removed if more documents of its host hold it than this, and than this share.
LINE_DOCS = 50
LINE_SHARE = 0.02
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.1
#: Frequent lines that are broadcast at most (2 MB and the hosts' names); beyond, the lists are joined by host.
BROADCAST_LINES = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CHARACTER = np.ones(256, bool)
_CHARACTER[0x80:0xC0] = False
_DIGIT = arrays.LOWER_ASCII.copy()
_DIGIT[48:58] = 48


def line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; lines are what \\n separates, so a text has one at least."""
    breaks = np.flatnonzero(data == 10)
    # a break that ends its text begins an empty line there, before the next text's first
    own = np.concatenate([np.arange(len(off) - 1), arrays.owner(off, breaks)])
    order = np.lexsort((np.concatenate([off[:-1], breaks + 1]), own))
    start = np.concatenate([off[:-1], breaks + 1])[order]
    own = own[order]
    last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[last] = off[1:][own[last]]
    return start, end, own


def repeats(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each item the first earlier-or-same item of its text with its key (its own index if first)."""
    key = arrays.mix(key ^ arrays.mix(own.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(key), bool)
    new[1:] = k[1:] != k[:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else order
    out = np.empty(len(key), np.int64)
    out[order] = first
    return out


def measure(array: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, off = arrays.utf8(array)
    n = len(off) - 1
    start, end, own = arrays.words(data, off)
    n_words = np.bincount(own, minlength=n)
    chars = np.concatenate(([0], np.cumsum(_CHARACTER[data])))
    word_chars = np.bincount(own, chars[end] - chars[start], minlength=n).astype(np.int64)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    n_symbols = symbols[off[1:]] - symbols[off[:-1]]

    prefix = arrays.prefix_hash(data)
    l_start, l_end, l_own = line_bounds(data, off)
    with_word = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_start, l_end, l_own = l_start[with_word], l_end[with_word], l_own[with_word]
    first = repeats(arrays.mix(arrays.span_hash(prefix, l_start, l_end) + (l_end - l_start).astype(np.uint64)), l_own)
    n_dup_lines = np.bincount(l_own[first != np.arange(len(first))], minlength=n)

    n_repeat = np.zeros(n, np.int64)
    if len(start) >= WINDOW:
        word = arrays.mix(arrays.span_hash(prefix, start, end) + (end - start).astype(np.uint64))
        window = word[: len(word) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            window = arrays.mix(window) + word[k : len(word) - WINDOW + 1 + k]
        inside = own[: len(window)] == own[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        first = repeats(window[at], own[at])
        twice = np.zeros(len(at), bool)
        again = first != np.arange(len(at))
        twice[again] = True
        twice[first[again]] = True
        cover = np.bincount(at[twice], minlength=len(word)) - np.bincount(at[twice] + WINDOW, minlength=len(word) + 1)[: len(word)]
        covered = np.cumsum(cover) > 0
        n_repeat = np.bincount(own[covered], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}


def normal_lines(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: text, hash when normalised, normalised length, words, and line number in its text."""
    data, off = arrays.utf8(pc.utf8_lower(pc.fill_null(array, "")))
    data = _DIGIT[data]
    start, end, own = arrays.words(data, off)
    l_start, _, l_own = line_bounds(data, off)
    number = np.arange(len(l_own)) - np.searchsorted(l_own, l_own)
    # the line of each word; an empty line may begin where the next one does
    line = np.searchsorted(l_start, start, side="right") - 1
    first, words = arrays.runs(line)
    word = arrays.mix(arrays.span_hash(arrays.prefix_hash(data), start, end) + (end - start).astype(np.uint64))
    if not len(line):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    # words in order: a polynomial of their hashes, by place in the line
    up, _ = arrays.powers(len(line))
    key = arrays.mix(np.add.reduceat(word * up[arrays.ramps(words)], first))
    length = np.add.reduceat(end - start, first) + words
    return own[first], key, length, words, number[line[first]]


LINES = "host string, line long, text_key long"


def line_evidence(docs: DataFrame) -> DataFrame:
    """host, line, text_key (a hash of the whole text) of each line of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            own, key, _, _, _ = normal_lines(piece.column("text"))
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([piece.column("source").take(at), pa.array(key.view(np.int64)), piece.column("text_key").take(at)], names=["host", "line", "text_key"])

    return docs.select("text", "source", F.xxhash64("text").alias("text_key")).transform(arrays.mapped, run, LINES)


def frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, line, n of lines above their host's limit; n and the host's documents count exact copies once.

    A host has at most its documents' mean number of lines divided by ``line_share`` of these.
    """
    texts = docs.select(F.col("source").alias("h"), F.xxhash64("text").alias("text_key")).groupBy("h", "text_key").agg(F.lit(1).alias("one"))
    hosts = texts.groupBy("h").agg(F.count("*").alias("n_docs"))
    pairs = line_evidence(docs).groupBy("host", "line", "text_key").agg(F.lit(1).alias("one"))
    lines = pairs.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > line_share * F.col("n_docs")).select("host", "line", "n")


def _host(column: str = "source") -> Column:
    """A host's key: unlike the host itself never null."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit("-"))


#: The frequent lines of a piece's hosts: in order of key and line hash, by host's key.
Lists = Callable[[pa.RecordBatch], dict[str, np.ndarray]]


def with_lines(docs: DataFrame, line_docs: int, line_share: float, broadcast: int) -> tuple[DataFrame, Lists]:
    """docs with ``host``, and what gives the frequent lines of the hosts in a piece of it.

    Few lines go to all tasks once. More are joined to the documents by host, where a host
    with very many documents is dealt to several tasks.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    found = scratch.written(frequent_lines(docs, line_docs, line_share).select(_host("host").alias("host"), "line"), "lines")
    lists = found.groupBy("host").agg(F.collect_list("line").alias("lines"))
    docs = docs.withColumn("host", _host())
    if found.count() <= broadcast:
        known = {r["host"]: np.sort(np.array(r["lines"], np.int64)) for r in lists.collect()}  # ``broadcast`` numbers at most
        scratch.clear()
        shipped = spark.sparkContext.broadcast(known)
        return docs, lambda piece: shipped.value
    hosts = docs.select("host", "doc_id")
    docs = skew.hot(hosts, ["host"]).joined(docs, lists, "text", "left")

    def of(piece: pa.RecordBatch) -> dict[str, np.ndarray]:
        at = piece.column("host").dictionary_encode()
        _, first = np.unique(np.asarray(at.indices), return_index=True)
        lines = piece.column("lines").take(pa.array(first)).to_pylist()
        return {h: np.array(x or [], np.int64) for h, x in zip(at.dictionary.to_pylist(), lines)}

    return docs, of


def _verdict(piece: pa.RecordBatch, lists: dict[str, np.ndarray], left_share: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, dict[int, set[int]]]:
    """Base counts, words left, kept, and the numbers of the lines to remove by text."""
    text, n = piece.column("text"), piece.num_rows
    base = measure(text)
    own, key, _, words, number = normal_lines(text)
    gone = np.zeros(len(own), bool)
    host = piece.column("host").dictionary_encode()
    at = np.asarray(host.indices)
    for k, name in enumerate(host.dictionary.to_pylist()):
        bad = lists.get(name)
        if bad is not None and len(bad):
            mine = np.flatnonzero(at[own] == k)
            gone[mine] = np.isin(key[mine].view(np.int64), bad)
    left = base["n_words"] - np.bincount(own, words * gone, minlength=n).astype(np.int64)
    base["base_failed"] = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
    cut: dict[int, set[int]] = {}
    for o, k in zip(own[gone].tolist(), number[gone].tolist()):
        cut.setdefault(o, set()).add(k)
    return base, left, ~base["base_failed"] & (left >= left_share * base["n_words"]), cut


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_left long, kept boolean"


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, base counts, base_failed, n_left (words outside removed lines), kept of each row."""
    rows, lists = with_lines(picked(docs, "doc_id", "source", "text"), line_docs, line_share, broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for piece in arrays.pieces(batches):
            base, left, kept, _ = _verdict(piece, lists(piece), left_share)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(base[c].astype(np.int64)) for c in names), pa.array(base["base_failed"]), pa.array(left), pa.array(kept)], names=["doc_id", *names, "base_failed", "n_left", "kept"])

    return rows.transform(arrays.mapped, run, JUDGED)


def cleaned(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """The rows of docs that are kept, all their columns, the text without its host's frequent lines."""
    plain, back = aside(docs, "doc_id", "source", "text")
    columns, schema = plain.columns, plain.schema
    rows, lists = with_lines(plain, line_docs, line_share, broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            _, _, kept, cut = _verdict(piece, lists(piece), left_share)
            texts = piece.column("text").to_pylist()
            for k, lines in cut.items():
                texts[k] = "\n".join(x for j, x in enumerate(texts[k].split("\n")) if j not in lines)
            piece = piece.set_column(piece.schema.names.index("text"), "text", pa.array(texts, pa.string()))
            yield piece.select(columns).filter(pa.array(kept))

    return back(rows.transform(arrays.mapped, run, schema))
