"""Toxicity by Levenshtein automata over a learned lexicon.

The lexicon comes from all labelled rows of a bounded sample: words that stand in many
toxic texts and hardly in others, and stems (ending in ``*``) that
many such words share. Near copies are no evidence of their own, so texts are counted by
family: those whose least 5-word shingle hash is the same count once for each label. A
stem counts by the number of its words in a text, for stems may stand once anywhere.
Lexicon trie and Levenshtein automaton are intersected into one table-driven automaton,
through which numpy drives all words of a batch a byte at a time, so misspelled terms are
found as well; two letters that changed places are one edit. A form counts by the share of
toxic texts among the training texts with it (an unseen form by that of its term and
distance), less inside a quotation and less where a word that reports speech stands near, so
that quoting is told from abuse. The score is a rising step function of what a text's hits
leave, fitted to the sample; or, if that is more, one minus what the words that tell by
themselves leave (each once, and less for each edit of a form that training has not seen),
so that one term is enough.

Words are runs of letters, marks and digits (Unicode's) of the lower-cased text, in training
as in scoring.

Defined results: null and empty texts, like all without a hit, get the least score; with nothing to learn from every score is 0;
labels that are null don't count; several labels of one id all count.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .language import fold, sampled
from .minhash import shingles
from .shared import Scratch, picked

#: Labelled rows used at most, on average; rows are chosen by a hash of doc_id.
TRAIN_ROWS = 24_000
#: A term stands in at least this share of the toxic texts.
LEAST_SHARE = 0.005
#: A term's toxic texts, were they drawn by chance, must be rarer than one in this many words.
CHANCE = 1e7
#: Characters of a stem, and the words that share it at least.
STEMS = range(3, 9)
STEM_WORDS = 5
LEAST_PRECISION = 0.9
#: The share of toxic texts among those that hold a term, were there as many of either kind, below which it tells nothing.
TERM_PRECISION = 0.95
#: Training texts that a form's own share must outweigh.
PRIOR_TEXTS = 4
#: What is left of a term's share for a form that training has not seen, by its distance.
MISSPELT = (1.0, 0.7, 0.25)
#: The most that a form can tell.
MOST = 0.999
THRESHOLD = 0.3
#: Words looked at on each side of a hit.
WINDOW = 12
QUOTED = 0.2
REPORTED = 0.6
#: Words that report speech.
REPORTING = frozenset(b"said says say called calls quoted quote wrote writes word term insult slur".split())
#: Marks that open, close, or do both.
OPENING, CLOSING, EITHER = ("“", "«", "„"), ("”", "»"), ('"',)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter, a mark or a digit; made once a worker."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)]))
    return _letters[0]


def edits_allowed(term: bytes) -> int:
    """0 for stems and the shortest terms, 1 from five bytes, 2 from nine."""
    return 0 if term.endswith(b"*") else (len(term) >= 5) + (len(term) >= 9)


@dataclass
class Automaton:
    """table[state, class of byte] -> state; state 0 is dead, 1 starts; accepts: term and distance or -1."""

    terms: list[bytes]
    classes: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)
    term: np.ndarray = field(init=False)
    distance: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        letters_ = sorted({b for t in self.terms for b in t.removesuffix(b"*")})
        self.classes = np.zeros(256, np.int64)  # class 0: bytes of no term
        for k, b in enumerate(letters_):
            self.classes[b] = k + 1
        children: list[dict[int, int]] = [{}]
        depth_left: list[int] = [0]  # edits that the best term below a node allows
        ends: dict[int, int] = {}
        stems: dict[int, int] = {}
        for k, t in enumerate(self.terms):
            node = 0
            allowed = edits_allowed(t)
            depth_left[0] = max(depth_left[0], allowed)
            for b in t.removesuffix(b"*"):
                c = int(self.classes[b])
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    depth_left.append(0)
                node = children[node][c]
                depth_left[node] = max(depth_left[node], allowed)
            (stems if t.endswith(b"*") else ends)[node] = k

        # a place in the trie with what the word must go on with, after two letters that changed places (-1: anything)
        def closed(pairs: dict[tuple[int, int], int]) -> frozenset:
            todo = list(pairs.items())
            while todo:  # a byte of the term left out
                (node, wanted), e = todo.pop()
                if wanted >= 0 or pairs.get((node, -1), 99) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= depth_left[child] and pairs.get((child, -1), 99) > e + 1:
                        pairs[child, -1] = e + 1
                        todo.append(((child, -1), e + 1))
            return frozenset(pairs.items())

        start = closed({(0, -1): 0})
        numbers, queue, rows, accept = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters_) + 1)], [(-1, 99)]
        while queue:
            state = queue.pop(0)
            whole = [(e, ends[n]) for (n, w), e in state if w < 0 and n in ends and e <= edits_allowed(self.terms[ends[n]])]
            best = min(whole + [(0, stems[n]) for (n, w), e in state if w < 0 and n in stems and e == 0], default=(99, -1))
            accept.append((best[1], best[0]))
            row = []
            for c in range(len(letters_) + 1):
                after: dict[tuple[int, int], int] = {}

                def reached(node: int, cost: int, wanted: int = -1) -> None:
                    if cost <= depth_left[node]:
                        after[node, wanted] = min(after.get((node, wanted), 99), cost)  # noqa: B023

                for (node, wanted), e in state:
                    if wanted >= 0:
                        if c == wanted:
                            reached(node, e)
                        continue
                    if node in stems and e == 0:
                        after[node, -1] = 0  # any ending
                    reached(node, e + 1)
                    for b, child in children[node].items():
                        reached(child, e + (b != c))
                        if b != c and c in children[child]:
                            reached(children[child][c], e + 1, b)
                new = closed(after)
                if new not in numbers:
                    numbers[new] = len(numbers)
                    queue.append(new)
                row.append(numbers[new])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.term = np.array([a for a, _ in accept], np.int32)
        self.distance = np.array([e for _, e in accept], np.int32)

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are accepted, with term and distance."""
        if not self.terms:
            return (np.zeros(0, np.int64),) * 3
        longest = max(len(t.removesuffix(b"*")) for t in self.terms) + 3
        alive = np.arange(len(start))
        state = np.ones(len(alive), np.int32)
        words, terms, distances = [], [], []
        for k in range(longest + 1):
            done = start[alive] + k >= end[alive]
            if k == longest:
                done[:] = True  # only stems are still alive, and accept any ending
            if done.any():
                found = done & (self.term[state] >= 0)
                words.append(alive[found])
                terms.append(self.term[state[found]])
                distances.append(self.distance[state[found]])
                alive, state = alive[~done], state[~done]
            if not len(alive):
                break
            state = self.table[state, self.classes[data[start[alive] + k]]]
            live = state > 0
            alive, state = alive[live], state[live]
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return word[order], np.concatenate(terms)[order] if words else word, np.concatenate(distances)[order] if words else word


def tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, where each text begins, and start, end, text of each word."""
    data, off = arrays.utf8(pc.utf8_lower(pc.fill_null(array, "")))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    solid = np.zeros(len(data) + 2, bool)
    here = solid[1:-1] = letters()[points][np.cumsum(lead) - 1]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(here & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(here & (~solid[2:] | edge[1:])) + 1
    return data, off, start, end, arrays.owner(off, start)


def in_quotes(before: str, after: str) -> bool:
    """Whether a quotation opens in ``before`` and closes in ``after``."""
    opened = 0
    for c in before:
        if c in OPENING:
            opened = 1
        elif c in CLOSING:
            opened = 0
        elif c in EITHER:
            opened ^= 1
    return bool(opened) and any(c in CLOSING or c in EITHER for c in after)


def hits(array: pa.Array, automaton: Automaton) -> Iterator[tuple[int, bytes, int, int, float]]:
    """Text, form, term, distance and context's factor of each hit."""
    data, off, start, end, own = tokens(array)
    word, term, distance = automaton.match(data, start, end)
    for w, t, d in zip(word.tolist(), term.tolist(), distance.tolist()):
        a, b = max(w - WINDOW, 0), min(w + WINDOW + 1, len(start))
        while own[a] != own[w]:
            a += 1
        while own[b - 1] != own[w]:
            b -= 1
        # with all that stands between the window and the next words
        begin = end[a - 1] if a and own[a - 1] == own[w] else off[own[w]]
        stop = start[b] if b < len(start) and own[b] == own[w] else off[own[w] + 1]
        left, right = data[begin : start[w]].tobytes().decode(), data[end[w] : stop].tobytes().decode()
        factor = QUOTED if in_quotes(left, right) else 1.0
        near = {data[start[k] : end[k]].tobytes() for k in range(max(a, w - 4), w)}
        if factor == 1.0 and near & REPORTING and any(c in left[-3:] for c in (*OPENING, *EITHER, "'")):
            factor = REPORTED
        yield int(own[w]), data[start[w] : end[w]].tobytes(), t, d, factor


@dataclass
class Model:
    automaton: Automaton
    #: Share of toxic texts of each form, and, by term and distance, of forms that training has not seen.
    forms: dict[bytes, float]
    unseen: dict[tuple[int, int], float]
    #: What each form of a word that is a term by itself tells, and its unseen ones by distance: 0 nothing, 1 certain.
    telling: dict[bytes, float] = field(default_factory=dict)
    telling_unseen: dict[tuple[int, int], float] = field(default_factory=dict)
    #: The share of toxic texts among those without a hit.
    base: float = 0.0
    #: Where a step of the score begins, by a text's evidence, and the score from there.
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def evidence(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minus the logarithm of what each text's hits leave, of what its telling terms leave (each once), and the number of hits."""
        total, sure, n = np.zeros(len(array)), np.zeros(len(array)), np.zeros(len(array), np.int64)
        told: dict[tuple[int, int], float] = {}
        for own, form, term, distance, factor in hits(array, self.automaton):
            n[own] += 1
            total[own] -= math.log(1 - factor * self.forms.get(form, self.unseen.get((term, distance), 0.5)))
            tells = factor * self.telling.get(form, self.telling_unseen.get((term, distance), 0.0))
            told[own, term] = max(tells, told.get((own, term), 0.0))
        for (own, _), tells in told.items():
            sure[own] -= math.log(1 - tells)
        return total, sure, n

    def fit(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """The rising step function that is closest to the labels, pooled until no step falls."""
        order = np.argsort(evidence, kind="stable")
        first, count = arrays.runs(evidence[order])
        pools: list[list[float]] = []
        for at, n, y in zip(evidence[order][first].tolist(), count.tolist(), np.add.reduceat(toxic[order], first).tolist()):
            pools.append([at, n, y])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                _, n, y = pools.pop()
                pools[-1][1] += n
                pools[-1][2] += y
        self.steps = np.array([p[0] for p in pools])
        self.scores = np.array([(y + toxic.mean()) / (n + 1) for _, n, y in pools])

    def score(self, evidence: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """The step of all evidence, or what the telling terms leave of a text without a hit, whichever says more."""
        step = self.scores[np.maximum(np.searchsorted(self.steps, evidence, side="right") - 1, 0)]
        return np.maximum(step, 1 - (1 - self.base) * np.exp(-sure))


def _families(rows: DataFrame) -> DataFrame:
    """text, toxic, family of labelled rows: the least hash of a text's 5-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            sets, bounds = shingles(piece.column("text"), 5)
            family = np.zeros(piece.num_rows, np.int64)
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                family[some] = np.minimum.reduceat(arrays.mix(sets), bounds[:-1][some]).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("text"), piece.column("toxic"), pa.array(family)], names=["text", "toxic", "family"])

    return rows.select("text", F.when(F.col("toxic") == 1, 1).otherwise(0).cast("long").alias("toxic")).transform(arrays.mapped, run, "text string, toxic long, family long")


def _words_of(texts: pa.Array) -> list[set[bytes]]:
    """The words of each text that hold more than digits."""
    data, _, start, end, own = tokens(texts)
    out: list[set[bytes]] = [set() for _ in range(len(texts))]
    raw = data.tobytes()
    for o, a, b in zip(own.tolist(), start.tolist(), end.tolist()):
        out[o].add(raw[a:b])
    return [{w for w in x if not w.isdigit()} for x in out]


def _stems_of(word: bytes) -> list[bytes]:
    text = word.decode()
    return [(text[:k] + "*").encode() for k in STEMS if len(text) > k]


def _occurrences(rows: DataFrame, among: set[bytes] | None = None) -> DataFrame:
    """word, n, m: families that hold each word, or words of a stem (of ``among``), and the sum of how many they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, int], int] = {}
        for piece in arrays.pieces(batches):
            for words, family in zip(_words_of(piece.column("text")), piece.column("family").to_pylist()):
                counts = Counter(x for w in words for x in (w, *_stems_of(w)) if among is None or x in among)
                for w, k in counts.items():
                    seen[w, family] = max(k, seen.get((w, family), 0))
        if seen:
            word, family = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(family, pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["word", "family", "k"])

    pairs = rows.select("text", "family").transform(arrays.mapped, run, "word binary, family long, k long").groupBy("word", "family").agg(F.max("k").alias("k"))
    return pairs.groupBy("word").agg(F.count("*").alias("n"), F.sum("k").alias("m"))


def lexicon(rows: DataFrame) -> list[bytes]:
    """Terms of (text, toxic, family): words, and stems that tell more than their most frequent word.

    The words of the sample's toxic texts that reach the driver are bounded by the sample.
    """
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.countDistinct("family").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    least = max(LEAST_SHARE * n_toxic, math.log(CHANCE) / math.log((n_toxic + n_clean) / n_toxic))
    toxic = {bytes(r["word"]): (r["n"], r["m"]) for r in _occurrences(rows.where("toxic = 1")).collect()}
    often = {w for w, (n, _) in toxic.items() if n >= least}
    family = {w for w in toxic if not w.endswith(b"*") and any(x in often for x in _stems_of(w))}
    clean = {bytes(r["word"]): (r["n"], r["m"]) for r in _occurrences(rows.where("toxic = 0"), often | family).collect()}

    def telling(w: bytes) -> bool:
        rate, other = toxic[w][1] / n_toxic, clean.get(w, (0, 0))[1] / n_clean
        return rate >= LEAST_PRECISION * (rate + other)

    members = defaultdict(list)
    for w in family:
        if toxic[w][0] > clean.get(w, (0, 0))[0]:
            for x in _stems_of(w):
                members[x].append(toxic[w][0])
    known = {w for w in often if telling(w)}
    stems = {x for x in known if x.endswith(b"*") and len(members[x]) >= STEM_WORDS and toxic[x][1] >= 1.5 * max(members[x])}
    terms = {w for w in known if not w.endswith(b"*") and not any(x in stems for x in _stems_of(w))}
    shortest = {x for x in stems if not any(y != x and x.startswith(y[:-1]) for y in stems)}
    return sorted(terms | shortest)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the texts of labelled rows; the labels broadcast are a bounded sample."""
    scratch = Scratch(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic")
    labels = sampled(labels, TRAIN_ROWS, labels.count())
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").where("text is not null")
    rows = scratch.written(_families(rows), "labelled")
    if rows.select("toxic").distinct().count() < 2:
        scratch.clear()
        return None
    automaton = Automaton(lexicon(rows))
    shipped = docs.sparkSession.sparkContext.broadcast(automaton)  # of a lexicon that the sample bounds

    def per_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[bytes, int, int, int, int]] = set()
        for piece in arrays.pieces(batches):
            seen = defaultdict(set)
            for own, form, term, distance, _ in hits(piece.column("text"), shipped.value):
                seen[own].add((form, term, distance))
            for own, (toxic, family) in enumerate(zip(piece.column("toxic").to_pylist(), piece.column("family").to_pylist())):
                exact = any(d == 0 for _, _, d in seen[own])
                for form, term, distance in seen[own] or {(b"", -1, -1)}:
                    if distance <= 0 or not exact:  # beside an exact hit a near one proves nothing
                        found.add((form, term, distance, toxic, family))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), *(pa.int64(),) * 4))], names=["form", "term", "distance", "toxic", "family"])

    forms = rows.transform(arrays.mapped, per_form, "form binary, term long, distance long, toxic long, family long").distinct()
    forms = scratch.written(forms, "forms")
    counts = (F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.countDistinct("family").alias("n")).collect()}
    balance = min(sizes[0] / sizes[1], 10.0)
    known = {(bytes(r["form"]), r["term"], r["distance"]): (r["toxic"] * balance, r["clean"]) for r in forms.where("term >= 0").groupBy("form", "term", "distance").agg(*counts).collect()}  # forms of the sample
    # texts that hold any form of a term, not its forms: a long text has many
    texts = {(r["term"], r["distance"]): (r["toxic"], r["clean"]) for r in forms.select("term", "distance", "toxic", "family").distinct().groupBy("term", "distance").agg(*counts).collect()}
    t, c = texts.pop((-1, -1), (0, 0))
    base = (t + 1) / (t + c + 2)
    exact, near = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [0.0, 0.0])
    for (term, distance), (t, c) in texts.items():
        group = exact[term] if distance == 0 else near[term, distance]
        group[0] += t * balance
        group[1] += c

    def told(toxic: float, clean: float, prior: float) -> float:
        return (toxic + PRIOR_TEXTS * prior) / (toxic + clean + PRIOR_TEXTS)

    groups = defaultdict(lambda: [1.0, 1.0])
    for (_, term, distance), (toxic, clean) in known.items():
        groups[term, distance][0] += toxic
        groups[term, distance][1] += clean
    model = Model(automaton, {}, {k: t / (t + c) for k, (t, c) in groups.items()}, base=base)
    for (form, term, distance), (toxic, clean) in known.items():
        model.forms[form] = told(toxic, clean, model.unseen[term, distance])
    # as toxic and clean texts count alike, a share of one half tells nothing
    tells = lambda share: min(max(2 * share - 1, 0.0), MOST)
    for term, name in enumerate(automaton.terms):
        share = exact[term][0] / sum(exact[term])
        if share >= TERM_PRECISION and not name.endswith(b"*"):
            for distance, left in enumerate(MISSPELT):
                model.telling_unseen[term, distance] = tells(share if distance == 0 else told(*near[term, distance], 0.5 + left * (share - 0.5)))
    for (form, term, distance), (toxic, clean) in known.items():
        if (term, distance) in model.telling_unseen:
            model.telling[form] = tells(told(toxic, clean, 0.5 + model.telling_unseen[term, distance] / 2))
    learned = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(learned.value.evidence(piece.column("text"))[0]), piece.column("toxic")], names=["evidence", "toxic"])

    seen = rows.transform(arrays.mapped, weigh, "evidence double, toxic long").toPandas()  # a row for each of the sample
    model.fit(seen["evidence"].to_numpy(), seen["toxic"].to_numpy(float))
    scratch.clear()
    return model


SCORED = "doc_id long, score double, n_hits long"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, n_hits of each row of (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_hits"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and forms of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            evidence, sure, n = shipped.value.evidence(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(shipped.value.score(evidence, sure)), pa.array(n)], names=["doc_id", "score", "n_hits"])

    return docs.select("doc_id", "text").transform(arrays.mapped, run, SCORED)


def detect(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The columns of the query: learns from labels outside the held fold, scores every text."""
    docs = picked(docs, "doc_id", "text")
    model = train(docs, picked(labels, "doc_id", "toxic").where(fold(folds) != held))
    out = score(docs, model)
    return out.select("doc_id", (fold(folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")
