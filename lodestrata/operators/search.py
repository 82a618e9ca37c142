"""Search over entries: candidate rules, the matcher, the cut in entry order, and ranking.

A result is in the candidates of every constraint and passes the matcher; rows are cut at
the limit in entry order (name hits first where one plain term allows it) and ranked only
then.

Which directory names qualify for a term depends on all of them, so a first pass gathers
the distinct directories' names, few beside the entries. The ones that qualify are then
tested in the same scan as the matcher; only where they are very many do entries meet
them in a join.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

ALNUM_SPLIT = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class FileQuery:
    """Constraints of a search, all of which must hold."""

    terms: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    dirs: tuple[str, ...] = ()
    contents: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return " ".join(self.terms)


def _lower(text: str) -> str:
    return text.translate(str.maketrans(P.UPPER, P.LOWER))


def fuzzy_pattern(term: str) -> str:
    """Leftmost greedy subsequence from the first character on."""
    first, *rest = term
    return "^" + re.escape(first) + "".join(f"[^{re.escape(c)}]*{re.escape(c)}" for c in rest)


def fuzzy_segment(term: str, segment: Column) -> Column:
    """Whether the term is a subsequence that begins the segment and spans twice its length, or 8, at most."""
    return F.length(F.regexp_extract(segment, fuzzy_pattern(term), 0)).between(1, max(2 * len(term), 8))


def term_matches(term: str) -> Column:
    term = _lower(term.strip())
    if not term:
        return F.lit(True)
    name = P.ascii_lower(F.col("name"))
    hit = lambda s: F.startswith(s, F.lit(term)) | fuzzy_segment(term, s)
    found = name.contains(term) | F.exists(F.split(name, ALNUM_SPLIT), hit) | F.exists(P.segments(P.ascii_lower(F.col("path"))), hit)
    if re.search(r"[/\\]", term):
        return found | F.lower("path").contains(term.lower())
    return found


def type_matches(extension: str) -> Column:
    return P.ascii_lower(P.effective_extension(F.col("name"), F.col("extension"))) == _lower(extension.lstrip("."))


def name_matches(part: str) -> Column:
    return P.ascii_lower(F.col("name")).contains(_lower(part))


def directory() -> Column:
    return F.when(F.col("parent") != "", F.replace("parent", F.lit("\\"), F.lit("/"))).otherwise(F.coalesce(P.parent_key(P.path_key(F.col("path"))), F.lit("")))


def dir_matches(part: str) -> Column:
    if re.search(r"[*?\[]", part):
        return directory().rlike(P.glob_regex(part.replace("\\", "/")))
    return P.ascii_lower(directory()).contains(_lower(part))


def matches(query: FileQuery) -> Column:
    tests = [*map(term_matches, query.terms), *map(type_matches, query.types), *map(name_matches, query.names), *map(dir_matches, query.dirs)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def directory_segments() -> Column:
    """Segments under which an entry is filed: a file's own name is not among them."""
    parts = F.transform(P.segments(F.col("path")), lambda s: F.regexp_replace(s, ":+$", ""))
    return F.when(F.col("kind") == "directory", parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))


def segment_table(entries: DataFrame) -> DataFrame:
    """segment (lower case) and written, its spelling in the first entry that has it.

    Entries of one directory have the same segments, so their first one stands for it.
    """
    filed = F.when(F.col("kind") == "directory", F.col("path")).otherwise(F.regexp_replace("path", r"[^/\\]*$", ""))
    dirs = entries.groupBy(filed.alias("dir")).agg(F.min(F.struct("path_key", "path")).alias("first"))
    parts = F.transform(P.segments(F.col("dir")), lambda s: F.regexp_replace(s, ":+$", ""))
    return dirs.select("first", F.explode(parts).alias("written")).groupBy(P.ascii_lower(F.col("written")).alias("segment")).agg(F.min_by("written", "first").alias("written"))


def _fuzzy(term: str) -> Column:
    """Same first character as written, and all letters of the term."""
    letters = sorted({c for c in term if c in P.LOWER})
    return F.startswith("written", F.lit(term[:1])) & reduce(lambda a, b: a & b, (F.col("segment").contains(c) for c in letters), F.lit(True))


#: Segments that are tested in the scan at most; more are joined.
SEGMENTS = 4096


def sought_segments(table: DataFrame, sought: list[str]) -> DataFrame:
    """segment, and for each of what is sought whether it begins with it, or is fuzzily like it; segments that are neither are left out."""
    rows = table.select("segment", *(c.alias(f"{kind}{k}") for k, t in enumerate(sought) for kind, c in (("begins", F.startswith("segment", F.lit(t))), ("fuzzy", _fuzzy(t)))))
    return rows.where(reduce(lambda a, b: a | b, (F.col(f"{kind}{k}") for k in range(len(sought)) for kind in ("begins", "fuzzy"))))


def kept_segments(rows: list, terms: list[str], dirs: list[str]) -> list[list[str]]:
    """Per term, and per directory constraint, the segments that qualify, of all the rows of ``sought_segments``.

    A term takes equal segments if there is one anywhere, else those that begin with it,
    and fuzzy ones; a directory constraint takes fuzzy ones only where there are no others.
    """
    out = []
    for k, t in enumerate(terms + dirs):
        precise = {r["segment"] for r in rows if r["segment"] == t} or {r["segment"] for r in rows if r[f"begins{k}"]}
        both = k < len(terms) or not precise
        out.append(sorted(precise | ({r["segment"] for r in rows if r[f"fuzzy{k}"]} if both else set())))
    return out


def qualifying(rows: DataFrame, terms: list[str], dirs: list[str]) -> list[DataFrame]:
    """What ``kept_segments`` gives, as tables of segments, however many they are."""
    sought = terms + dirs
    # what is sought is known on the driver, so are the two facts about all segments
    facts = rows.agg(*(f for k, t in enumerate(sought) for f in (F.coalesce(F.bool_or(F.col("segment") == t), F.lit(False)), F.coalesce(F.bool_or(f"begins{k}"), F.lit(False))))).first()
    out = []
    for k, t in enumerate(sought):
        exact, begins = facts[2 * k], facts[2 * k + 1]
        precise = F.col("segment") == t if exact else F.col(f"begins{k}")
        keep = precise | F.col(f"fuzzy{k}") if k < len(terms) or not begins else precise
        out.append(rows.where(keep).select("segment"))
    return out


def under_any(segments: list[str]) -> Column:
    """Whether an entry is filed under any of the segments."""
    return F.exists(F.transform(directory_segments(), P.ascii_lower), lambda s: s.isin(*segments)) if segments else F.lit(False)


def filed_under(entries: DataFrame, segments: DataFrame) -> tuple[DataFrame, Column]:
    """entries, and whether each is filed under any of the segments, which may be very many."""
    lower = F.transform(directory_segments(), P.ascii_lower)
    name = f"under{uuid.uuid4().hex}"
    filed = entries.select("path_key", "path", F.explode(F.array_distinct(lower)).alias("segment")).join(segments, "segment", "left_semi").select("path_key", "path", F.lit(True).alias(name)).distinct()
    return entries.join(filed, ["path_key", "path"], "left"), F.coalesce(name, F.lit(False))


def candidates(entries: DataFrame, query: FileQuery, most: int = SEGMENTS) -> tuple[DataFrame, Column]:
    """entries, and whether each is a candidate of all constraints."""
    test = F.lit(True)
    terms = [t for t in map(_lower, query.terms) if not re.search(r"[/\\]", t)]
    dirs = [d for d in map(_lower, query.dirs) if not re.search(r"[*?\[]", d)]
    columns = entries.columns
    tests = []
    if terms or dirs:
        rows = sought_segments(segment_table(entries), terms + dirs)
        some = rows.limit(most + 1).collect()
        if len(some) <= most:
            tests = [under_any(segments) for segments in kept_segments(some, terms, dirs)]
        else:
            for segments in qualifying(rows, terms, dirs):
                entries, under = filed_under(entries, segments)
                tests.append(under)
    for k, under in enumerate(tests):
        test &= (P.ascii_lower(F.col("name")).contains(terms[k][:3]) | under) if k < len(terms) else under
    for t in map(_lower, query.terms):
        if re.search(r"[/\\]", t):  # a whole path hides what only contains it
            whole = P.ascii_lower(F.col("path")) == t
            test &= whole | ~F.lit(bool(not entries.select(*columns).where(whole).isEmpty()))
    return entries, test


def search(entries: DataFrame, query: FileQuery, limit: int = 20, visible: Column | None = None, most: int = SEGMENTS) -> DataFrame:
    """Entries that the query finds, cut at the limit in entry order; a visibility filter comes before the cut."""
    if limit <= 0 or query == FileQuery():
        return entries.limit(0)
    columns = entries.columns
    rows, candidate = candidates(entries, query, most)
    found = rows.where(candidate & matches(query))
    if visible is not None:
        found = found.where(visible)
    found = found.select(*columns)
    order = [F.col("path_key"), F.col("path")]
    if len(query.terms) == 1 and not any(re.search(r"[*?\[]", d) for d in query.dirs):
        order.insert(0, ~P.ascii_lower(F.col("name")).contains(_lower(query.terms[0])[:3]))
    return found.orderBy(*order).limit(limit)


def regex_search(entries: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Entries whose name or path matches, case-sensitive and unanchored, in entry order; raises re.error for a bad pattern."""
    re.compile(pattern)
    return entries.where(F.col("name").rlike(pattern) | F.col("path").rlike(pattern)).orderBy("path_key", "path").limit(limit)


#: The ranker's weights.
EXACT, FUZZY, APPLICATION, FILE, HISTORY, DEPTH = 1000, 25, 500, 250, 10, 3


def score(query: str, history: Column) -> Column:
    query = query.strip().lower()
    text = F.lower(F.concat_ws(" ", "name", "path"))
    loose = "(?s)" + ".*".join(map(re.escape, query))
    base = F.when(F.lit(bool(query)) & text.contains(query), EXACT).when(text.rlike(loose), FUZZY).otherwise(0)
    kind = F.when(F.col("kind") == "application", APPLICATION).when(F.col("kind") == "file", FILE).otherwise(0)
    return (base + kind + HISTORY * history - DEPTH * F.size(P.segments(F.col("path")))).cast("long")


def rank(found: DataFrame, query: str, usage: DataFrame | None = None) -> DataFrame:
    """path, name, kind, score by falling score, name and path; usage has (path, open_count)."""
    history = F.lit(0)
    if usage is not None:
        found = found.join(usage.select(F.col("path").alias("__path"), "open_count"), F.col("path") == F.col("__path"), "left")
        history = F.coalesce("open_count", F.lit(0))
    return found.select("path", "name", "kind", score(query, history).alias("score")).orderBy(F.desc("score"), "name", "path")


def results(found: DataFrame) -> DataFrame:
    """The display record of each entry: identity, title, detail, actions."""
    more = F.when(F.col("kind") == "directory", F.array(F.lit("open_terminal"), F.lit("copy_path"))).otherwise(F.array(F.lit("reveal"), F.lit("copy_path"), F.lit("open_with")))
    return found.select(F.concat(F.lit("path:"), "path").alias("id"), F.col("name").alias("title"), F.col("path").alias("detail"), "kind", F.lit("open").alias("action"), more.alias("more_actions"))


RESULT = "id string, title string, detail string, kind string, action string, more_actions array<string>"


def feedback(spark: SparkSession, name: str, title: str, detail: str) -> DataFrame:
    """One row that tells why there are no results."""
    return spark.createDataFrame([(f"feedback:{name}", title, detail, "feedback", "copy", [])], RESULT)


def regex_results(entries: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """The display records of a pattern's entries, or feedback on a bad pattern."""
    try:
        return results(regex_search(entries, pattern, limit))
    except re.error as error:
        return feedback(entries.sparkSession, "invalid-regex", "not a regular expression", str(error))


def layered_results(baseline: DataFrame, overlay: DataFrame, query: FileQuery, budget: int) -> DataFrame:
    """Results of two layers of a catalog: ``budget`` of each, the baseline's first, one for each id, twice the budget at most.

    What the overlay hides is no part of ``baseline``.
    """
    order = ["layer", "place"]
    parts = []
    for layer, entries in enumerate((baseline, overlay)):
        found = search(entries, query, budget)
        parts.append(results(found).withColumn("layer", F.lit(layer)).withColumn("place", F.monotonically_increasing_id()))
    both = parts[0].unionByName(parts[1])  # twice the budget at most
    once = both.groupBy("id").agg(F.min_by(F.struct(*both.columns), F.struct(*order)).alias("r")).select("r.*")
    return once.orderBy(*order).limit(2 * budget).drop(*order)
