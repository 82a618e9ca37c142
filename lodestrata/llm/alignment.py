"""Which tokens of two tokenizers cover each other, through a dictionary of token groups.

A text, with a space before it, is encoded by A (byte-level BPE) and B (pieces with byte
fallback, which adds that space itself). Byte offsets where tokens of both end cut the
tokens into groups; a link is a pair of tokens, one of each, whose bytes overlap. Links
never leave a group, and a group's ids say which of them overlap. So:

1. Each text gives its distinct groups and how often each stands in it. Words with a space
   before them are encoded alike wherever they stand, so a task encodes each of a bounded
   number of words once (whole texts where the tokenizers' rules don't allow it).
2. The dictionary interns the distinct groups with their frequency over all texts. Links
   are expanded once for each of its groups and multiplied by the frequency: that gives the
   count of every id pair, and the best count of each B id.
3. The pairs' counts return to the groups as three sums, and these to the texts. The most
   frequent groups, a bounded number of them, are told to all tasks; occurrences of the
   others are joined by group.

Defined results: a text that is null or empty, or whose tokens' bytes differ from space and
text, has no tokens: zeros, and '' for its digest. Special tokens' names in texts are plain
text. Rows count one by one, also where they repeat; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, skew
from .shared import Scratch, picked, written

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Words that a task keeps encoded, twice this at most, and the longest of them.
KEPT_WORDS, LONGEST_WORD = 250_000, 48
#: Words that are encoded at once, and how many of them as one text.
AT_ONCE, JOINED = 4096, 64
#: Groups that are told to all tasks at most (a few megabytes).
TOLD_GROUPS = 1 << 17
#: A single space between characters that aren't white space.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible Latin-1 characters are themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        before = json.loads(self.a.to_str())
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        split = before["normalizer"] is None and (before["pre_tokenizer"] or {}).get("type") == "ByteLevel" and before["pre_tokenizer"].get("use_regex")
        #: Whether words can be encoded one by one: A cuts before a space, and no piece of B goes on over one.
        self.by_word = bool(split) and not any("▁" in p.lstrip("▁") for p in pieces)

    def encoded(self, words: list[str]) -> dict[str, tuple[str, int, int] | None]:
        """Groups, number of A and of B tokens of each of the distinct words (with the space before them); None where bytes differ."""
        out: dict[str, tuple[str, int, int] | None] = {}
        # words without other white space at their ends are encoded alike when they follow each other
        alone = [w for w in words if not self.by_word or w[1:2].isspace() or w[-1].isspace()]
        joint = [w for w in words if self.by_word and not (w[1:2].isspace() or w[-1].isspace())]
        for k in range(0, len(joint), AT_ONCE):
            parts = [joint[j : j + JOINED] for j in range(k, min(k + AT_ONCE, len(joint)), JOINED)]
            texts = ["".join(p) for p in parts]
            both = zip(parts, texts, (x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)), self.b.encode([t[1:] for t in texts], num_threads=1))
            good: tuple[list, list, list] = ([], [], [])
            for part, text, a, b in both:
                if self._same(text.encode(), a, b):
                    for held, new in zip(good, (part, a, b)):
                        held += new
                else:
                    alone += part
            if good[0]:
                out.update(zip(good[0], self._grouped(*good)))
        for k in range(0, len(alone), AT_ONCE):
            some = alone[k : k + AT_ONCE]
            for w, x, b in zip(some, self.a.encode_batch_fast(some, add_special_tokens=False), self.b.encode([w[1:] for w in some], num_threads=1)):
                out[w] = next(iter(self._grouped([w], x.ids, b))) if self._same(w.encode(), x.ids, b) else None
        return out

    def _same(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a)) == raw

    def _grouped(self, words: list[str], a: list[int], b: list[int]) -> Iterator[tuple[str, int, int]]:
        """Groups and numbers of tokens of words that follow each other, whose tokens are a and b."""
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        at = np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)
        last_a = np.flatnonzero(b_end[at] == a_end)
        last_b = at[last_a]
        first_a, first_b = (np.concatenate(([0], x[:-1] + 1)) for x in (last_a, last_b))
        single = (first_a == last_a) & (first_b == last_b)
        pair, number = np.unique(a_ids[first_a[single]] << 32 | b_ids[first_b[single]], return_inverse=True)
        names = np.empty(len(single), object)
        names[single] = np.array([f"{x >> 32}|{x & 0xFFFFFFFF}" for x in pair.tolist()], object)[number]
        names = names.tolist()
        spans = (x.tolist() for x in (np.flatnonzero(~single), first_a[~single], last_a[~single], first_b[~single], last_b[~single]))
        for k, a0, a1, b0, b1 in zip(*spans):
            names[k] = f"{','.join(map(str, a[a0 : a1 + 1]))}|{','.join(map(str, b[b0 : b1 + 1]))}"
        # each word's last byte ends a group
        to = np.searchsorted(a_end[last_a], np.cumsum([len(w.encode()) for w in words])) + 1
        n_a, n_b = (np.diff(x[to - 1], prepend=-1) for x in (last_a, last_b))
        begin = 0
        for end, x, y in zip(to.tolist(), n_a.tolist(), n_b.tolist()):
            yield ";".join(names[begin:end]), x, y
            begin = end

    def links(self, group: str) -> Counter[tuple[int, int]]:
        """How often each id pair is linked in a group."""
        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
        found: Counter[tuple[int, int]] = Counter()
        i = j = 0
        end_a, end_b = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            found[a[i], b[j]] += 1
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                i += 1
                if i == len(a):
                    return found
                end_a += len(self.a_bytes[a[i]])
            if step_b:
                j += 1
                end_b += len(self.b_bytes[b[j]])


_loaded: dict[tuple[str, str], Tokenizers] = {}
_words: dict[tuple[str, str], Words] = {}


def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """Loaded once a worker."""
    if (a_file, b_file) not in _loaded:
        _loaded[a_file, b_file] = Tokenizers(a_file, b_file)
    return _loaded[a_file, b_file]


def words(a_file: str, b_file: str) -> Words:
    """A worker's words, which its tasks go on with."""
    if (a_file, b_file) not in _words:
        _words[a_file, b_file] = Words(tokenizers(a_file, b_file))
    return _words[a_file, b_file]


class Words:
    """The words encoded last: when as many new ones have come as are kept, those unused since go."""

    def __init__(self, with_: Tokenizers, kept: int = KEPT_WORDS):
        self.tokenizers, self.kept = with_, kept
        self.new: dict[str, tuple[str, int, int] | None] = {}
        self.old: dict[str, tuple[str, int, int] | None] = {}

    def split(self, text: str) -> list[str]:
        """The words of space and text, each with the space before it."""
        if not self.tokenizers.by_word:
            return [" " + text]
        first, *rest = _BETWEEN.split(text)
        return [" " + first, *(" " + w for w in rest)]

    def known(self, words: Iterable[str]) -> dict[str, tuple[str, int, int] | None]:
        """The groups of all of these words."""
        out, missing = {}, []
        for w in words:
            if w in self.new:
                out[w] = self.new[w]
            elif w in self.old:
                out[w] = self.new[w] = self.old[w]
            else:
                missing.append(w)
        found = self.tokenizers.encoded(missing)
        out |= found
        self.new.update((w, x) for w, x in found.items() if len(w) <= LONGEST_WORD)
        if len(self.new) > self.kept:
            self.old, self.new = self.new, {}
        return out


ENCODED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<string>, times array<int>"


def encoded(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """doc_id, numbers of tokens and groups, the digest of all groups in order, and the distinct ones with their times of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = words(a_file, b_file)
        for piece in arrays.pieces(batches):
            split = [memory.split(t) if t else [] for t in piece.column("text").to_pylist()]
            known = memory.known(dict.fromkeys(chain.from_iterable(split)))
            rows = []
            for doc_id, parts in zip(piece.column("doc_id").to_pylist(), split):
                found = [known[w] for w in parts]
                if not found or None in found:
                    rows.append((doc_id, 0, 0, 0, "", [], []))
                    continue
                groups = ";".join([x[0] for x in found])
                each = groups.split(";")
                times = Counter(each)
                rows.append((doc_id, sum([x[1] for x in found]), sum([x[2] for x in found]), len(each), hashlib.sha256(groups.encode()).hexdigest(), list(times), list(times.values())))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times"])

    return picked(docs, "doc_id", "text").transform(arrays.mapped, run, ENCODED)


@dataclass
class Alignment:
    """``documents``: ENCODED and ``row``; ``groups``: group, frequency and its links' sums; ``pairs``: a, b, n, best (whether n is b's highest)."""

    documents: DataFrame
    groups: DataFrame
    pairs: DataFrame


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> Alignment:
    """The alignment of all texts."""
    scratch = Scratch(docs.sparkSession)
    texts = scratch.written(encoded(docs, a_file, b_file).withColumn("row", F.monotonically_increasing_id()), "encoded", "zstd")
    occurrences = texts.select(F.explode(F.arrays_zip("groups", "times")).alias("g")).select(F.col("g.groups").alias("group"), F.col("g.times").alias("times"))
    dictionary = occurrences.groupBy("group").agg(F.sum("times").alias("frequency"))
    dictionary = scratch.written(dictionary.withColumn("id", F.monotonically_increasing_id()), "groups")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizers(a_file, b_file)
        for batch in batches:
            found = [(i, n, a, b, k) for group, n, i in zip(*(batch.column(c).to_pylist() for c in ("group", "frequency", "id"))) for (a, b), k in known.links(group).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)], names=["id", "frequency", "a", "b", "times"])

    links = scratch.written(dictionary.transform(arrays.mapped, expand, "id long, frequency long, a long, b long, times long"), "links")
    counts = scratch.written(links.groupBy("a", "b").agg(F.sum(F.col("frequency") * F.col("times")).alias("n")), "counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    pairs = scratch.written(skew.hot(counts, ["b"]).joined(counts, highest, "a").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")
    each = skew.hot(links, ["a", "b"]).joined(links, pairs, "id")
    sums = each.groupBy("id").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    groups = scratch.written(dictionary.join(sums, "id").select("group", "frequency", "n_links", "n_best", "count_sum"), "sums")
    return Alignment(texts, groups, pairs)


SUMS = ("n_links", "n_best", "count_sum")


def report(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, told: int = TOLD_GROUPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    found = aligned(docs, a_file, b_file)
    often = found.groups.orderBy(F.desc("frequency"), "group").limit(told).select("group", *SUMS).toArrow()  # ``told`` rows at most
    shipped = docs.sparkSession.sparkContext.broadcast((often.column("group").combine_chunks(), [often.column(c).to_numpy() for c in SUMS]))
    plain = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shipped.value
        for batch in batches:
            lists = batch.column("groups")
            groups, times = lists.flatten(), batch.column("times").flatten()
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(lists.value_lengths(), 0)))
            at = pc.index_in(groups, value_set=known)
            told = np.asarray(at.is_valid())
            place, n = np.asarray(at.fill_null(0)), np.asarray(times).astype(np.int64)

            def added(values: np.ndarray) -> pa.Array:
                out = np.zeros(batch.num_rows, np.int64)  # noqa: B023
                np.add.at(out, row[told], values[place[told]] * n[told])  # noqa: B023
                return pa.array(out)

            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~told], minlength=batch.num_rows)))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(ends, x.filter(pa.array(~told))) for x in (groups, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *map(added, sums), *rest], names=[*plain, *SUMS, "groups", "times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, groups array<string>, times array<int>"
    summed = written(found.documents.select(*plain, "groups", "times").transform(arrays.mapped, run, schema), "summed", "zstd")
    rare = summed.select("row", F.explode(F.arrays_zip("groups", "times")).alias("g")).select("row", F.col("g.groups").alias("group"), F.col("g.times").alias("times"))
    rare = skew.hot(rare, ["group"]).joined(rare, found.groups.select("group", *SUMS), "row")
    rare = rare.groupBy("row").agg(*(F.sum(F.col("times") * F.col(c)).alias(f"rare_{c}") for c in SUMS))
    added = [(F.col(c) + F.coalesce(f"rare_{c}", F.lit(0))).alias(c) for c in SUMS]
    return summed.drop("groups", "times").join(rare, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *added, "groups_sha256")
