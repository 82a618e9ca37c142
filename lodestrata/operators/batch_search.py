"""File searches of a whole table of requests in one pass over a stored name index.

What is typed is split into constraints; equal ones of different requests are looked up
once: their grams and extensions in the postings, their directory names among the stored
directories. The entries found are tested against each constraint once, pairs of constraint
and entry return to the requests that have it, and a request's entries are those that meet
all its constraints, cut at the limit as ``search.search`` cuts them.

Requests with a slash in a term or a glob in a directory, or without any constraint of the
names' kind, are not answered here; ``plain`` tells them apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import paths as P
from . import search as S
from .name_index import NameIndex
from .requests import file_query

#: Parts of a request's hits that are ranked by themselves first.
PARTS = 64
_FIELDS = StructType([StructField(c, ArrayType(StringType())) for c in ("terms", "types", "names", "dirs", "contents")])


@F.pandas_udf(_FIELDS)
def fields(text: pd.Series) -> pd.DataFrame:
    """The constraints of what was typed, A-Z in lower case (contents as they are)."""
    queries = [file_query(t or "") for t in text]
    lower = lambda values: [S._lower(v) for v in values]
    return pd.DataFrame({"terms": [lower(q.terms) for q in queries], "types": [lower(q.types) for q in queries], "names": [lower(q.names) for q in queries], "dirs": [lower(q.dirs) for q in queries], "contents": [list(q.contents) for q in queries]})


def plain(asked: Column) -> Column:
    """Whether a request of these fields is answered here."""
    slash = F.exists(asked["terms"], lambda t: t.rlike(r"[/\\]") | (F.trim(t) == ""))
    glob = F.exists(asked["dirs"], lambda d: d.rlike(r"[*?\[]"))
    some = F.size(asked["terms"]) + F.size(asked["types"]) + F.size(asked["names"]) + F.size(asked["dirs"]) > 0
    return some & ~slash & ~glob & (F.size(asked["contents"]) == 0)


def _fuzzy_pattern(term: Column) -> Column:
    """``search.fuzzy_pattern`` of a column."""
    chars = F.transform(F.filter(F.split(term, ""), lambda c: c != ""), lambda c: F.when(c.rlike(r"^\p{Punct}$"), F.concat(F.lit("\\"), c)).otherwise(c))
    rest = F.transform(F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda c: F.concat(F.lit("[^"), c, F.lit("]*"), c))
    return F.concat(F.lit("^"), F.get(chars, F.lit(0)), F.array_join(rest, ""))


def _term_matches(term: Column, pattern: Column) -> Column:
    """``search.term_matches`` of a column."""
    name = P.ascii_lower(F.col("name"))
    hit = lambda s: F.startswith(s, term) | F.length(F.regexp_substr(s, pattern)).between(F.lit(1), F.greatest(2 * F.length(term), F.lit(8)))
    found = lambda parts: F.exists(parts, lambda s: F.coalesce(hit(s), F.lit(False)))
    return name.contains(term) | found(F.split(name, S.ALNUM_SPLIT)) | found(P.segments(P.ascii_lower(F.col("path"))))


def _qualifying(index: NameIndex, values: DataFrame) -> DataFrame:
    """kind, value, segment: what ``search.kept_segments`` gives for each term and directory constraint."""
    segments = index.directories().groupBy("segment").agg(F.min_by("written", "seen").alias("written"))
    values = values.where("kind in ('term', 'dir')")
    begins = F.transform(F.sequence(F.lit(1), F.length("segment")), lambda n: F.substring(F.col("segment"), F.lit(1), n))
    precise = segments.where("segment != ''").select("segment", F.explode(begins).alias("value")).join(values, "value").select("kind", "value", "segment", (F.col("segment") == F.col("value")).alias("exact"))
    facts = precise.groupBy("kind", "value").agg(F.max("exact").alias("any_exact"))
    kept = precise.join(facts, ["kind", "value"]).where(F.col("exact") | ~F.col("any_exact")).select("kind", "value", "segment")
    letters = F.filter(F.split("value", ""), lambda c: c.rlike("^[a-z]$"))
    like = values.join(facts, ["kind", "value"], "left").where("kind = 'term' or any_exact is null")
    like = like.withColumn("initial", F.substring("value", 1, 1)).join(segments.withColumn("initial", F.substring("written", 1, 1)), "initial")
    like = like.where(F.forall(letters, lambda c: F.contains(F.col("segment"), c))).select("kind", "value", "segment")
    return kept.unionByName(like).distinct()


def search_many(index: NameIndex, requests: DataFrame, limit: int = 20) -> DataFrame:
    """key, place (from 1) and the entry of each result of requests (key, fields as ``asked``) that are ``plain``."""
    asked = requests.where(plain(F.col("asked"))).select("key", "asked")
    kinds = (("term", "terms"), ("extension", "types"), ("name", "names"), ("dir", "dirs"))
    each = F.flatten(F.array(*(_constraints(field, kind) for kind, field in kinds)))
    wanted = asked.select("key", F.size("asked.terms").alias("n_terms"), F.explode(each).alias("c")).select("key", "n_terms", "c.kind", "c.value")
    values = wanted.select("kind", "value").distinct()

    entries = index.entries()
    posted = index.postings().withColumnRenamed("kind", "posting").withColumnRenamed("value", "gram")
    sought = values.select("kind", "value", F.when(F.col("kind") == "extension", "extension").otherwise("gram").alias("posting"), F.when(F.col("kind") == "extension", F.col("value")).otherwise(F.substring("value", 1, 3)).alias("gram")).where("kind != 'dir'")
    by_name = sought.join(posted, ["posting", "gram"]).select("kind", "value", F.lit(True).alias("named"), F.explode(F.transform("offsets", lambda o: F.col("block") * index.block + o)).alias("id"))
    filed = entries.select("id", F.explode(F.array_distinct(F.transform(S.directory_segments(), P.ascii_lower))).alias("segment")).join(_qualifying(index, values), "segment")
    pairs = by_name.unionByName(filed.select("kind", "value", F.lit(False).alias("named"), "id")).groupBy("kind", "value", "id").agg(F.max("named").alias("named"))
    tested = pairs.withColumn("pattern", F.when(F.col("kind") == "term", _fuzzy_pattern(F.col("value")))).join(entries.select("id", "name", "path", "kind", "parent", "extension").withColumnRenamed("kind", "entry_kind"), "id")
    value = F.col("value")
    test = F.when(F.col("kind") == "term", _term_matches(value, F.col("pattern"))).when(F.col("kind") == "name", P.ascii_lower(F.col("name")).contains(value)).when(F.col("kind") == "dir", P.ascii_lower(S.directory()).contains(value)).otherwise(F.lit(True))
    met = tested.where(test).select("kind", "value", "id", "named")
    need = wanted.groupBy("key").agg(F.count("*").alias("need"), F.max("n_terms").alias("n_terms"))
    hits = wanted.select("key", "kind", "value").join(met, ["kind", "value"]).groupBy("key", "id").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "term", F.col("named"))).alias("named"))
    hits = hits.join(need, "key").where("n = need").select("key", "id", F.when(F.col("n_terms") == 1, ~F.col("named")).otherwise(False).alias("later"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part"))
    for by in (["key", "part"], ["key"]):
        hits = hits.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("later", "id"))).where(F.col("place") <= limit)
    return hits.select("key", "place", "id").join(entries, "id").drop("id", "block")


def _constraints(field: str, kind: str) -> Column:
    return F.transform(F.array_distinct(F.col("asked")[field]), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def file_rows(found: DataFrame) -> DataFrame:
    """key, id, title, detail, kind, provider, action, place of what was found: the files' share of all providers' rows."""
    return found.select("key", F.concat(F.lit("path:"), "path").alias("id"), F.col("name").alias("title"), F.col("path").alias("detail"), "kind", F.lit("files").alias("provider"), F.lit("open").alias("action"), F.col("place").cast("long").alias("place"))
