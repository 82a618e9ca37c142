"""Full text: tokens, boolean BM25, snippets with highlights, content of a catalog's files.

Terms are counted inside a text's array of words, so a text never leaves its row: the
corpus is read once for a handful of sums and once for the hits, and only hits move.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .changes import under
from .search import FileQuery, results, search

K1, B = 1.2, 0.75
TOKEN_BYTES = 40
#: Kinds of files whose text is not extracted.
OPAQUE = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
#: What a hit in both name and content gets on top; hits looked at for each result, at least and at most.
BOTH, HITS_EACH, HITS_LEAST, HITS_MOST = 10_000, 4, 10, 10_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, without those over 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.octet_length(w) <= TOKEN_BYTES))


def tokens(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, term, tf of (key, content): the postings of an index."""
    return texts.select(key, F.explode(words(F.col("content"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


# ---------------------------------------------------------------- queries


class InvalidQuery(ValueError):
    """A content query that means nothing."""


@dataclass(frozen=True)
class ContentQuery:
    """Groups of clauses, one of which must hold with all its clauses; clauses that must or must not hold.

    A clause is a phrase, or a query of its own (what stands in brackets).
    """

    groups: tuple[tuple[Clause, ...], ...] = ()
    must: tuple[Clause, ...] = ()
    never: tuple[Clause, ...] = ()

    @property
    def parts(self) -> tuple[Clause, ...]:
        """The clauses that may add to a score."""
        return tuple(dict.fromkeys([c for g in self.groups for c in g] + list(self.must)))

    @property
    def positive(self) -> tuple[tuple[str, ...], ...]:
        """The phrases that may add to a score."""
        return tuple(dict.fromkeys(p for c in self.parts for p in ((c,) if isinstance(c, tuple) else c.positive)))

    @property
    def clauses(self) -> tuple[tuple[str, ...], ...]:
        """All phrases."""
        return tuple(dict.fromkeys(p for c in self.parts + self.never for p in ((c,) if isinstance(c, tuple) else c.clauses)))

    def holds(self, tf: dict[tuple[str, ...], Column]) -> Column:
        """Whether a text is found in which each phrase stands so often."""
        each = lambda c: tf[c] > 0 if isinstance(c, tuple) else c.holds(tf)
        all_of = lambda cs: reduce(lambda a, b: a & b, map(each, cs), F.lit(True))
        any_of = lambda tests, none: reduce(lambda a, b: a | b, tests, F.lit(none))
        return any_of(map(all_of, self.groups), not self.groups) & all_of(self.must) & ~any_of(map(each, self.never), False)

    def score(self, weights: dict[tuple[str, ...], Column], tf: dict[tuple[str, ...], Column]) -> Column:
        """The sum of the phrases' weights; of a query in brackets only where it holds."""
        each = lambda c: weights[c] if isinstance(c, tuple) else F.when(c.holds(tf), c.score(weights, tf)).otherwise(0.0)
        return reduce(lambda a, b: a + b, map(each, self.parts))


Clause = tuple[str, ...] | ContentQuery
_CLAUSE = re.compile(r'([+-]?)(?:"([^"]*)"|(\()|([^\s"()]+))|(\))')


def content_query(text: str) -> ContentQuery:
    """Words, quoted phrases and queries in brackets: either will do, unless joined by AND or marked + (must) or - or NOT (must not)."""
    if text.count('"') % 2:
        raise InvalidQuery(text)
    items = list(_CLAUSE.finditer(text))
    found = _query(items, text, False)
    if items:  # a bracket that nothing opened
        raise InvalidQuery(text)
    return found


def _query(items: list[re.Match], text: str, inside: bool) -> ContentQuery:
    """The clauses up to the closing bracket, or the end; they are taken from items."""
    groups: list[list] = []
    must, never, joins, negated, closed = [], [], False, False, False
    while items and not closed:
        sign, phrase, opens, word, closed = items.pop(0).groups()
        if closed:
            if not inside:
                raise InvalidQuery(text)
            break
        if word in ("AND", "OR", "NOT") and not sign:
            joins, negated = (word == "AND") or (joins and word == "NOT"), word == "NOT"
            continue
        clause = _query(items, text, True) if opens else tuple(w for w in re.split(r"[\W_]+", (phrase or word or "").lower()) if w and len(w.encode()) <= TOKEN_BYTES)
        if clause:
            if negated or sign == "-":
                never.append(clause)
            elif sign == "+":
                must.append(clause)
            elif joins and groups:
                groups[-1].append(clause)
            else:
                groups.append([clause])
        joins = negated = False
    if joins or negated or inside and not closed or not (groups or must):
        raise InvalidQuery(text)
    return ContentQuery(tuple(map(tuple, groups)), tuple(must), tuple(never))


def _times(found: Column, clause: tuple[str, ...]) -> Column:
    """How often a phrase stands in an array of words."""
    if len(clause) == 1:
        return F.size(F.filter(found, lambda w: w == clause[0]))
    starts = F.when(F.size(found) >= len(clause), F.sequence(F.lit(0), F.size(found) - len(clause))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda k: reduce(lambda a, b: a & b, (F.get(found, k + j) == w for j, w in enumerate(clause)))))


def bm25(texts: DataFrame, query: ContentQuery, key: str = "path", only: DataFrame | None = None) -> DataFrame:
    """key, score of the texts (key, content) that the query finds; ``only`` (key) restricts the hits, not the statistics."""
    singles = list(dict.fromkeys(w for c in query.positive for w in c))
    clauses = list(query.clauses)

    def counts(found: Column) -> Column:
        """All that is told of a text, so that it is cut into words once."""
        tf = {c: _times(found, c) for c in clauses}
        return F.struct(F.size(found).alias("dl"), query.holds(tf).alias("found"), *(tf[c].alias(f"c{k}") for k, c in enumerate(clauses)), *(F.when(F.array_contains(found, w), 1).otherwise(0).alias(f"t{k}") for k, w in enumerate(singles)))

    counted = texts.select(key, F.transform(F.array(words(F.col("content"))), counts)[0].alias("n"))
    n, average, *df = counted.agg(F.count("*"), F.avg("n.dl"), *(F.sum(f"n.t{k}") for k in range(len(singles)))).first()
    idf = {w: F.log(1 + (F.lit(float(n)) - (d or 0) + 0.5) / ((d or 0) + 0.5)) for w, d in zip(singles, df)}
    hits = counted.where("n.found")
    if only is not None:
        hits = hits.join(only, key, "left_semi")
    norm = K1 * (1 - B + B * F.col("n.dl") / F.lit(average or 1.0))
    tf = {c: F.col(f"n.c{k}") for k, c in enumerate(clauses)}
    weights = {c: reduce(lambda a, b: a + b, (idf[w] for w in c)) * tf[c] * (K1 + 1) / (tf[c] + norm) for c in query.positive}
    return hits.select(key, F.round(query.score(weights, tf), 6).alias("score"))


# ---------------------------------------------------------------- snippets


def highlight_terms(query: str) -> list[str]:
    """The words of a query that are looked for literally, in order."""
    parts = (re.sub(r"^[\W_]+|[\W_]+$", lambda m: "_" * m[0].count("_"), t) for t in re.split(r"[\s\"':()+-]", query))
    return [t.translate(str.maketrans(P.UPPER, P.LOWER)) for t in parts if t]


def snippet(text: Column, query: str, around: int = 5) -> Column:
    """start_line, lines, highlights around the first line that holds the first of the query's terms found, null if none is.

    A highlight is line, start_column, end_column (1-based bytes, end exclusive) and
    matched_text, for every occurrence of every term in these lines, in order of terms.
    """
    terms = highlight_terms(query)
    if not terms:
        return F.lit(None)
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    low = F.transform(lines, P.ascii_lower)
    first = F.coalesce(*(F.nullif(F.array_position(F.transform(low, lambda x: x.contains(t)), True), F.lit(0)) for t in terms))  # noqa: B023
    start = F.greatest(first - around, F.lit(1)).cast("int")
    shown = F.slice(lines, start, (F.least(first + around, F.size(lines)) - start + 1).cast("int"))

    def marks(term: str) -> Column:
        """The highlights of one term: what stands before each occurrence tells its place."""

        def of_line(line: Column, k: Column) -> Column:
            cut = F.split(P.ascii_lower(line), f"\\Q{term}\\E", -1)
            before = lambda i: F.array_join(F.slice(cut, F.lit(1), i), term)
            column = lambda i: F.octet_length(before(i)) + 1
            mark = lambda i: F.struct((start + k).cast("long").alias("line"), column(i).cast("long").alias("start_column"), (column(i) + F.lit(len(term.encode()))).cast("long").alias("end_column"), F.substring(line, F.length(before(i)) + 1, len(term)).alias("matched_text"))
            return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(1), F.size(cut) - 1), mark)).otherwise(F.array().cast(_MARKS))

        return F.flatten(F.transform(shown, of_line))

    return F.when(first.isNotNull(), F.struct(start.cast("long").alias("start_line"), shown.alias("lines"), F.flatten(F.array(*map(marks, terms))).alias("highlights")))


_MARKS = "array<struct<line:bigint,start_column:bigint,end_column:bigint,matched_text:string>>"


# ---------------------------------------------------------------- content of a catalog


def extract_state(kind: Column, extension: Column, size: Column, content: Column, most: int) -> Column:
    """State of a file's text: unsupported, skipped_too_large, skipped_binary or indexed."""
    binary = content.contains(F.lit("\0"))
    return F.when((kind != "file") | extension.isin(*OPAQUE), "unsupported").when(size > most, "skipped_too_large").when(binary, "skipped_binary").otherwise("indexed")


def content_search(entries: DataFrame, texts: DataFrame, query: FileQuery, limit: int = 20) -> DataFrame:
    """The results of a search with content constraints: display columns, score, snippet.

    texts: path, content. Hits are the best of the texts whose entry is indexed, or, where
    the query has other constraints, of the entries these find; hits without a literal
    term are dropped.
    """
    text = " ".join(query.contents)
    others = FileQuery(query.terms, query.types, query.names, query.dirs)
    mixed = others != FileQuery()
    found = search(entries, others, limit) if mixed else entries.where("content_index_state = 'indexed'")
    scored = bm25(texts, content_query(text), "path", found.select("path") if mixed else None)
    best = scored.orderBy(F.desc("score"), "path").limit(min(max(HITS_EACH * limit, HITS_LEAST), HITS_MOST))
    shown = texts.join(best, "path").select("path", "score", snippet(F.col("content"), text).alias("snippet")).where("snippet is not null")
    shown = shown.orderBy(F.desc("score"), "path").limit(limit)
    rows = results(found).join(shown.withColumnRenamed("path", "detail"), "detail")
    score = F.round(1000 * F.col("score")).cast("long") + (BOTH if mixed else 0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "title", "id").limit(limit)


def content_delta(texts: DataFrame, removed: DataFrame, upserts: DataFrame) -> DataFrame:
    """texts (path_key, content) without what is at or below the removed keys, with the upserted ones; null contents only remove."""
    kept = under(texts, removed, "left_anti").join(upserts.select("path_key"), "path_key", "left_anti")
    return kept.unionByName(upserts.where("content is not null").select(*texts.columns))
