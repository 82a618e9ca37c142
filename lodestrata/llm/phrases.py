"""Phrase collocations of each language: sketch bounds, automata, exact counts.

Texts are lower-cased (A-Z), split at CUTS into pieces and those into words at spaces and
tabs. A phrase is 2 to 4 words that follow each other in a piece.

1. Sketches: every task adds its words and pairs, with their language, to a count-min
   sketch of saturating bytes, raising a cell no further than a phrase's bound needs. Of
   the merged sketch one bit a cell remains: whether its count reaches ``least``. A second
   pass makes the sketch of longer phrases, but adds only those whose pairs are all likely:
   of very many phrases that come once or twice, few are. A sketch says "no" only for what
   is rarer. It has at most CELLS cells; a fuller one only lets more phrases pass.
2. Automata: a shard is a few megabytes of one language's pieces. Its words are coded by
   a few characters each, its pieces delimited by one that no phrase holds, so that a match
   can't begin or end inside a word or run over a piece. Its phrases whose bounds,
   and whose inner phrases' bounds, reach ``least`` are the candidates; they are compiled
   into an Aho-Corasick automaton that counts all their matches in the shard, overlaps
   included. A shard holds all the candidates that can match in it, so counts summed
   over shards, first over those of a task, by the numbers of their words, are exact,
   whatever the number of candidates over all. There is a task for each core, so that a
   phrase is not told once more for each further part of a larger table; beyond TASK bytes,
   where a task can't hold all its phrases anyway, each core has more.
3. Sums at or above ``least`` are kept. A phrase's parts are at least as frequent as
   itself, so their counts are there: two joins give the scores of all cuts, a grouping
   the longer phrases that hold a phrase.

Defined results: a null text is empty; a null language is ``und``, like that name itself;
rows that repeat count each; languages are compared exactly; ties are broken by frequency,
then by the phrase's UTF-8 bytes; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import steady
from . import arrays, sketches, skew
from .shared import Scratch, count_partitions, picked

#: What ends a piece, and what stands between words.
CUTS = b".,;:!?\n\v\f\r"
BLANKS = b" \t"
LONGEST = 4
LEAST = 30
#: A candidate goes if a longer one around it has this percentage of its frequency.
COVERED = 80
SCALE = 2_000_000
TOP = 2000
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Cells of each sketch at most, and text bytes for which one is made.
CELLS, CELL_BYTES = 1 << 28, 64
#: Words of the phrases whose sketch is made first.
PAIR = 2
#: Bytes of words that are hashed one by one.
LONG_WORD = 256
#: Bytes of a shard.
SHARD = 4 << 20
#: Characters of a coded word.
DIGITS = 3
#: Text bytes of a task at most, about.
TASK = 1 << 30
#: Rows of its shards that a task holds until it sums them, about; 16 bytes each, or 24.
SUMMED = 3 << 22
#: Words of a task that are still known once rows were passed on early.
NAMES = 1 << 20
#: Rows that a task passes on at once.
SENT_ROWS = 1 << 16

_CUT = np.zeros(256, bool)
_CUT[list(CUTS)] = True
_WORD = ~_CUT
_WORD[list(BLANKS)] = False
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[tuple[str, np.ndarray]]:
    """Language and lower-cased bytes of about ``size``, whole pieces only; texts end with a cut."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def parts(lang: str) -> Iterator[tuple[str, np.ndarray]]:
        data = arrays.LOWER_ASCII[np.frombuffer(b"\n".join(held.pop(lang)) + b"\n", np.uint8)]
        sizes.pop(lang)
        if len(data) <= 2 * size:
            yield lang, data
            return
        cuts = np.flatnonzero(_CUT[data]) + 1
        begin = 0
        while begin < len(data):
            end = int(cuts[min(np.searchsorted(cuts, begin + size), len(cuts) - 1)])
            yield lang, data[begin:end]
            begin = end

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if not text.is_valid:
                continue
            raw = text.as_buffer().to_pybytes()
            held.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw)
            if sizes[lang] >= size:
                yield from parts(lang)
            elif sum(sizes.values()) >= 2 * size:  # many languages: the fullest goes early
                yield from parts(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from parts(lang)


def word_hashes(lang: str, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word and the language, eight bytes at a time; of long words all at once."""
    lanes = np.lib.stride_tricks.as_strided(np.concatenate((data, np.zeros(8, np.uint8)))[:8].view(np.uint64), (len(data) + 1,), (1,))
    size = end - start
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    found = arrays.mix(size.astype(np.uint64) + np.uint64(seed)) + (lanes[start] & _FIRST[np.minimum(size, 8)])
    at = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(at):
        found[at] = arrays.mix(found[at]) + (lanes[start[at] + done] & _FIRST[np.minimum(size[at] - done, 8)])
        done += 8
        at = at[size[at] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        found[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed)
    return arrays.mix(found)


class Shard:
    """Words of a shard: where each begins and ends, ``piece`` numbers the pieces; ``word`` is a hash of each word."""

    def __init__(self, lang: str, data: np.ndarray):
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = _WORD[data]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end, self.solid = edge[::2], edge[1::2], solid[1:-1]
        first = np.zeros(len(self.start) + 1, np.int64)
        first[np.searchsorted(self.start, np.flatnonzero(_CUT[data]))] = 1
        self.piece = np.cumsum(first[:-1])
        self.word = word_hashes(lang, data, self.start, self.end)

    def inside(self, n: int) -> np.ndarray:
        """Starts of n words that stand in one piece."""
        last = len(self.word) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def phrase_hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        """A hash of the n words that begin at each place."""
        found = self.word[at]
        for k in range(1, n):
            found = arrays.mix(found) + self.word[at + k]
        return arrays.mix(found + np.uint64(n))


class Coded(Shard):
    """A shard whose distinct words are numbered in order of appearance by ``codes``, as in ``words`` and ``hashes``."""

    def __init__(self, lang: str, data: np.ndarray):
        super().__init__(lang, data)
        offsets = np.concatenate(([0], np.cumsum(self.end - self.start)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[self.solid])])
        table = words.dictionary_encode()
        self.codes = np.asarray(table.indices).astype(np.int64)
        self.words = table.dictionary
        self.hashes = np.zeros(len(self.words), np.uint64)
        self.hashes[self.codes] = self.word


def by_core(docs: DataFrame, size: int) -> DataFrame:
    """docs, of ``size`` text bytes, in a partition for each core (or ``spark.default.parallelism``) and each TASK, if it has more."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return docs.coalesce(cores * count_partitions(spark, size, TASK * cores, 1))  # no core waits for a few last tasks


def half(bits: np.ndarray, n: int) -> np.ndarray:
    """The sketch for phrases of n words: the first half of the bits for PAIR words at most, the other for longer ones."""
    return bits[: len(bits) // 2] if n <= PAIR else bits[len(bits) // 2 :]


def likely(docs: DataFrame, longest: int, least: int, cells: int) -> np.ndarray:
    """The bits of two merged sketches: of words and pairs, and of longer phrases all whose pairs are likely."""
    if not 0 < least < 256:
        raise ValueError("least must be within 1 and 255: the sketch counts in bytes")
    merge = lambda a, b: np.minimum(a.astype(np.uint16) + b, 255).astype(np.uint8)

    def sketched(run: Callable[[Shard], list[np.ndarray]]) -> np.ndarray:
        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(cells, np.uint8)
            with steady():
                for lang, data in shards(batches):
                    sketches.add(counts, np.concatenate(run(Shard(lang, data))))
            yield from sketches.sent(enumerate(counts.reshape(-1, sketches.BLOCK)))

        return sketches.bits(docs.transform(arrays.mapped, tasks, sketches.SENT), cells, merge, lambda x: x >= least)

    short = sketched(lambda shard: [shard.phrase_hashes(n, shard.inside(n)) for n in range(1, min(longest, PAIR) + 1)])
    if longest <= PAIR:
        return np.concatenate((short, np.zeros_like(short)))
    shipped = docs.sparkSession.sparkContext.broadcast(short)

    def longer(shard: Shard) -> list[np.ndarray]:
        found, at = [], shard.inside(PAIR)
        here = np.zeros(len(shard.word) + longest, bool)
        here[at[sketches.has(shipped.value, shard.phrase_hashes(PAIR, at))]] = True
        for n in range(PAIR + 1, longest + 1):
            at = np.flatnonzero(here)
            here[at] = here[at + 1]  # n - 1 words from at, and from the next word
            found.append(shard.phrase_hashes(n, np.flatnonzero(here)))
        return found

    return np.concatenate((short, sketched(longer)))


def likely_words(shard: Coded, bits: np.ndarray) -> np.ndarray:
    """Whether each distinct word may be frequent."""
    return sketches.has(half(bits, 1), arrays.mix(shard.hashes + np.uint64(1)))  # as phrase_hashes(1)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and each key's number among them."""
    order = np.argsort(keys)
    first, lengths = arrays.runs(keys[order])
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(first)), lengths)
    return order[first], number


def candidates(shard: Coded, bits: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n its candidates: a start of each distinct one; and of all starts whether one is there."""
    ids = shard.codes
    if not len(ids):
        return
    word = likely_words(shard, bits)[ids]
    likely_at = np.flatnonzero(word)
    yield 1, likely_at[_numbered(ids[likely_at])[0]], word
    before, pair = word, None
    for n in range(2, longest + 1):
        here = np.zeros(len(ids), bool)
        at = shard.inside(n)
        at = at[before[at] & before[at + 1]]  # both inner phrases are candidates
        at = at[sketches.has(half(bits, n), shard.phrase_hashes(n, at))]
        here[at] = True
        # exact numbers: a phrase of n words is one of n - 1 and its last word
        first, number = _numbered((ids if pair is None else pair)[at] << 32 | ids[at + n - 1])
        pair = np.zeros(len(ids), np.int64)
        pair[at] = number
        yield n, at[first], here
        before = here


COUNTS = "lang string, words int, phrase string, n long"


def shard_counts(lang: str, data: np.ndarray, bits: np.ndarray, longest: int) -> pa.RecordBatch:
    """COUNTS of a shard, a phrase as the list of its words."""
    shard = Coded(lang, data)
    good = likely_words(shard, bits)
    found = list(candidates(shard, bits, longest))
    used = np.zeros(len(shard.codes), bool)
    if len(found) > 1:
        used |= found[1][2]
        used[1:] |= found[1][2][:-1]
    text, place = _coded(shard, used, good)
    number = (np.cumsum(good) - 1).astype(np.int32)
    sizes, words, totals = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [len(shard.codes)]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    known = 1
    for n, starts, here in found:
        if n == 1:
            totals += np.bincount(shard.codes[here], minlength=len(good))[shard.codes[starts]].tolist()
        else:
            width = DIGITS * n
            for k, a in enumerate(place[starts].tolist(), known):
                automaton.add_word(text[a : a + width], k)
        known += len(starts)
        sizes.append(np.full(len(starts), n))
        words.append(number[shard.codes[starts[:, None] + np.arange(n)]].reshape(-1))
    matches = np.zeros(known, np.int64)
    if len(automaton):
        automaton.make_automaton()
        matches += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=known)
    matches[: len(totals)] = totals
    sizes = np.concatenate(sizes)
    names = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(words)), shard.words.filter(pa.array(good)).cast(pa.large_string()).cast(pa.string()))
    phrases = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), names)
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(known, np.int8))), pa.array(sizes.astype(np.int32)), phrases, pa.array(matches)], names=["lang", "words", "phrase", "n"])


class Sums:
    """A task's counts: for each language and length the words' numbers, two in a column of 64 bits, and how often they come."""

    def __init__(self):
        self.names: dict[str, dict[str, int]] = {}  # of each language
        self.held: dict[tuple[str, int], list[list[np.ndarray]]] = {}  # columns and counts, in parts
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows as those of shard_counts; a phrase may be one string."""
        phrase, words, n = batch.column("phrase"), np.asarray(batch.column("words")), np.asarray(batch.column("n"))
        if not pa.types.is_list(phrase.type):
            phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(phrase) + 1, dtype=np.int32)), phrase.dictionary_encode())
        begin, tokens = np.asarray(phrase.offsets).astype(np.int64), phrase.values
        langs = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            numbers = self.names.setdefault(lang, {})
            here = np.asarray(langs.indices) == k
            own = np.array([numbers.setdefault(w, len(numbers)) for w in tokens.dictionary.to_pylist()], np.int64)
            coded = own[np.asarray(tokens.indices)] if len(own) else own
            for size in np.unique(words[here]).tolist():
                at = np.flatnonzero(here & (words == size))
                width = int(begin[at[0] + 1] - begin[at[0]])
                columns = [coded[begin[at] + j] << 32 | (coded[begin[at] + j + 1] if j + 1 < width else 0) for j in range(0, width, 2)]
                self.held.setdefault((lang, size), []).append([*(columns or [np.zeros(len(at), np.int64)]), n[at]])
        self.rows += batch.num_rows

    def sum(self) -> None:
        """Each phrase in one row."""
        for key, parts in self.held.items():
            *columns, n = parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns)
            columns = [x[order] for x in columns]
            new = np.ones(len(n), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
            first = np.flatnonzero(new)
            parts.append([*(x[first] for x in columns), np.add.reduceat(n[order], first) if len(n) else n])
        self.rows = sum(len(parts[0][-1]) for parts in self.held.values())

    def taken(self, kept: int = 0) -> Iterator[pa.RecordBatch]:
        """COUNTS of the summed rows, which are gone then, but for the ``kept`` most frequent."""
        sizes = [len(parts[0][-1]) for parts in self.held.values()]
        stay = np.zeros(sum(sizes), bool)
        if kept:
            stay[np.argpartition(np.concatenate([parts[0][-1] for parts in self.held.values()]), -kept)[-kept:]] = True
        names = {lang: pa.array(list(numbers), pa.string()) for lang, numbers in self.names.items()}
        for ((lang, size), parts), keep in zip(list(self.held.items()), np.split(stay, np.cumsum(sizes)[:-1])):
            part = parts.pop()
            parts.append([x[keep] for x in part])
            *columns, n = (x[~keep] for x in part)
            for a in range(0, len(n), SENT_ROWS):
                here = slice(a, a + SENT_ROWS)
                tokens = [names[lang].take(pa.array(half)) for x in columns for half in (x[here] >> 32, x[here] & 0xFFFFFFFF)][:size]
                phrase = pc.binary_join_element_wise(*tokens, " ") if tokens else pa.array([""] * len(n[here]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), pa.array(np.full(len(phrase), size, np.int32)), phrase, pa.array(n[here])], names=["lang", "words", "phrase", "n"])
        self.rows = int(stay.sum())
        if not kept:
            self.__init__()


def summed(rows: Iterable[pa.RecordBatch], most: int = SUMMED) -> Iterator[pa.RecordBatch]:
    """COUNTS with each phrase once, instead of once a shard.

    At ``most`` rows they are summed. Sums that take more than half of that are passed on
    early, but for the most frequent quarter of ``most``, whose phrases come again; beyond
    NAMES words all are.
    """
    sums = Sums()
    for batch in rows:
        sums.add(batch)
        if sums.rows >= most:
            sums.sum()
            if 2 * sums.rows > most:
                yield from sums.taken(most // 4 if sum(map(len, sums.names.values())) <= NAMES else 0)
    sums.sum()
    yield from sums.taken()


def counted(docs: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """Counts of the candidates in each shard, of likely words (words = 1), and of all words (words = 0)."""
    shipped = docs.sparkSession.sparkContext.broadcast(bits)  # CELLS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady():
            yield from summed(shard_counts(lang, data, shipped.value, longest) for lang, data in shards(batches))

    return docs.transform(arrays.mapped, run, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _coded(shard: Coded, used: np.ndarray, good: np.ndarray) -> tuple[str, np.ndarray]:
    """The shard's text with DIGITS characters for each word that a candidate of several uses, and where each word begins.

    A delimiter stands between pieces and for any other word. Each digit has characters of
    its own, so that a match begins with a word's first and ends with a word's last one,
    and no node of the automaton has many children. Words that appear early, most of them
    frequent, share their first digits and come first among a node's children.
    """
    base = 1
    while base**DIGITS < good.sum():
        base += 1
    before = np.zeros(len(used), np.int64)
    before[1:] = np.diff(shard.piece) > 0
    width = before + np.where(used, DIGITS, 1)
    place = np.cumsum(width) - width + before
    text = np.zeros(int(width.sum()), np.uint32)  # 0 delimits
    rest, at = (np.cumsum(good) - 1)[shard.codes[used]], place[used]
    for digit in reversed(range(DIGITS)):
        text[at + digit] = 1 + digit * base + rest % base
        rest = rest // base
    return text.astype("<u4").tobytes().decode("utf-32-le"), place


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k (the cut) of each language's first phrases.

    A cut after k words has l = f(first k words), r = f(the rest) and the score
    floor(SCALE * a / (l + r)); a phrase has its lowest cut's.
    """
    docs = picked(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = sketches.text_bytes(docs)
    docs = by_core(docs, size)
    bits = likely(docs, longest, least, cells or sketches.room(size, CELL_BYTES, CELLS))
    scratch = Scratch(docs.sparkSession)
    found = scratch.written(counted(docs, bits, longest).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    words = found.where("words = 0").select("lang", F.col("n").alias("words_n"))
    counts = found.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    phrases = found.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("at"))

    # words hold no space: phrase and list of words are the same thing
    joined = lambda begin, size: F.array_join(F.slice("at", begin, size), " ")
    inner = phrases.where("words > 2").select("lang", "a", "at", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), b -> array_join(slice(at, b, m), ' '))))")).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    whole = phrases.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around").cast("decimal(30,0)") < covered * F.col("a").cast("decimal(30,0)"), F.lit(True)))

    cuts = whole.select("lang", "phrase", "words", "a", "at", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = scratch.written(cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words")).alias("rest")), "cuts")
    for part, name, hot in [(p, n, skew.hot(cuts, ["lang", p])) for p, n in (("first", "l"), ("rest", "r"))]:
        cuts = hot.joined(cuts, counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), "phrase")
    score = F.expr(f"(a * {SCALE}BD) div (l + r)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    # a language's best are among the best of its parts: no task sees more than PARTS * top of them
    ranked = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words_n").alias("n"), "score", "k")


#: The first phrases in SQL.
ORACLE = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[b:b + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS b FROM pieces, (SELECT unnest(range(1, {LONGEST} + 1)) AS m))
),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inside AS (
  SELECT lang, array_to_string(w[b:b + s - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS b FROM (SELECT *, unnest(range(2, m)) AS s FROM c))
  GROUP BY 1, 2
),
whole AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < {COVERED} * a),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM whole),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(a AS HUGEINT) * {SCALE}) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts
  JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
