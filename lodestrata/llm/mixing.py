"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / weight, with u from a hash of its id and
text and the weight from its quality. Within a source the smallest keys come first; a
target is met by whole passes over the source and then by the first documents in key
order until the remaining words are spent.

The order within a source is a prefix sum that no task sees whole: keys fall into buckets
of equal width on a logarithmic scale, buckets are summed and accumulated per source, and
rows are ordered inside a bucket only. Whatever its weight, an exponential key falls into
a given interval of the width d of its natural logarithm with a probability of d / e at
most, so the width that a source's number of documents calls for bounds every bucket.
Rows alike in id, source and text are folded before and unfolded after.

Sources may be as many as hosts: they are ranked by range, and the level at which capped
targets leave the rest is found by sums over all of them, repeated until no further source
is capped.

Defined results: null text has size 0 and is never taken; a null source is a source of
its own, last in order; rows with equal keys are ordered by doc_id and then by text; of rows
alike in all of these as many are taken as fit the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, aside, picked, ranked

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Weights of the sources in order of code point, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents that a bucket of keys holds on average.
BUCKET_ROWS = 10_000


def quality(text: Column) -> Column:
    """Weight in (0, 1]: falls with the share of symbols among the characters."""
    return 1 / (1 + 20.0 * F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)) / F.greatest(F.coalesce(F.length(text), F.lit(1)), F.lit(1)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the parts' md5."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def measured(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, weight, digest, copies, key of the different rows; copies: how many are alike."""
    text = F.col("text")
    digest = F.md5(F.coalesce(text, F.lit("")))
    out = docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), quality(text).alias("weight"), digest.alias("digest"))
    out = out.groupBy("doc_id", "source", "digest").agg(F.first("size").alias("size"), F.first("weight").alias("weight"), F.count("*").alias("copies"))
    return out.withColumn("key", -F.log(uniform(F.lit(seed), F.col("doc_id"), F.col("digest"))) / F.col("weight"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source from (source, source_size).

    A source whose share would exceed ``most`` times its size stops there and the rest
    share what is left. That only raises the others' shares, so the set of those that stop
    grows until it is the right one.
    """
    rows = ranked(sizes.select(F.col("source").isNull().alias("unknown"), "source", "source_size"), "unknown", "source")
    rows = rows.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    is_open, level = F.lit(True), None
    while True:
        size = F.coalesce(F.col("source_size"), F.lit(0))
        total, capped, ws = rows.agg(F.sum(size), F.sum(F.when(is_open, 0).otherwise(size)), F.sum(F.when(is_open, F.col("w")).otherwise(0))).first()
        left = share * (total or 0) - most * (capped or 0)
        if not ws or level == (left, ws):
            break
        level = (left, ws)
        is_open = F.col("w") * F.lit(left) < most * F.col("source_size") * F.lit(ws)
    full = (most * F.col("source_size")).cast("double")
    target = full if not ws else F.when(is_open, F.col("w") * F.lit(left) / F.lit(ws)).otherwise(full)
    return rows.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, digest of every row."""
    each = _plan(docs, weights, share, most, seed).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.withColumn("taken", F.when(F.col("copy") <= F.col("more"), F.col("taken_more")).otherwise(F.col("taken"))).drop("copies", "copy", "more", "taken_more")


#: Of a source's documents this part at most falls, on average, into one octave's share 1 / n of buckets, times n.
OCTAVE = math.log(2) / math.e


def _plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mixture of the different rows, with their number as ``copies``; ``more`` of these are taken_more words, the others taken."""
    rows = Scratch(docs.sparkSession).written(measured(picked(docs, "doc_id", "source", "text"), seed), "measured")
    source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("source_rows"))
    goal = targets(source.select("source", "source_size"), weights, share, most)
    goal = source.join(goal.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = goal.select("source", "source_size", "target", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).alias("epochs"), F.ceil(OCTAVE * F.col("source_rows") / BUCKET_ROWS).alias("per_octave"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = rows.join(goal.select(F.col("source").alias("s"), "per_octave"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.floor(F.log2("key") * F.col("per_octave")))
    buckets = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("before"))
    buckets = buckets.join(goal.drop("per_octave").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "epochs", "rest")
    rows = rows.drop("per_octave").join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    all_copies = F.col("size") * F.col("copies")
    left = F.col("rest") - (F.col("before") + F.sum(all_copies).over(inside) - all_copies)
    # copies that cross the budget are taken if more than half of one fits after the others
    fit = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).otherwise(0)
    words = lambda passes: F.least(F.col("size") * passes, most * F.col("size")).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", words(F.col("epochs")).alias("taken"), "digest", "copies", F.greatest(F.least(fit, "copies"), F.lit(0)).alias("more"), words(F.col("epochs") + 1).alias("taken_more"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs, all its columns, as many times as it is taken."""
    passes = lambda taken: (F.col(taken) / F.col("size")).cast("int")
    plan = _plan(docs, **options).where("size > 0").select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("digest").alias("p_digest"), "copies", "more", passes("taken").alias("fewer"), passes("taken_more").alias("most"))
    rows, back = aside(docs, "doc_id", "source", "text")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("p_digest")) & F.col("source").eqNullSafe(F.col("p_source"))
    repeated = lambda found, times: found.withColumn("times", times).where("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).select(*rows.columns)
    # of a source's rows alike, those at the end of its budget are not all taken alike
    cut = F.col("more").between(1, F.col("copies") - 1)
    out = repeated(rows.join(plan.where(~cut), same), F.when(F.col("more") > 0, F.col("most")).otherwise(F.col("fewer")))
    split = Scratch(docs.sparkSession).written(plan.where(cut), "cut")  # a row a source at most
    if not split.isEmpty():
        placed = ranked(rows.join(split, same), "p_id", "p_source", "p_digest")
        begin = placed.groupBy("p_id", "p_source", "p_digest").agg(F.min("rank").alias("begin")).select(F.col("p_id").alias("b_id"), F.col("p_source").alias("b_source"), F.col("p_digest").alias("b_digest"), "begin")
        placed = placed.join(begin, F.col("p_id").eqNullSafe(F.col("b_id")) & F.col("p_source").eqNullSafe(F.col("b_source")) & (F.col("p_digest") == F.col("b_digest")))
        out = out.unionByName(repeated(placed, F.when(F.col("rank") - F.col("begin") < F.col("more"), F.col("most")).otherwise(F.col("fewer"))))
    return back(out)


ORACLE = r"""
WITH r AS (
  SELECT doc_id, source, text, md5(coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         1 / (1 + 20.0::DOUBLE * coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) / greatest(coalesce(length(text), 1), 1)) AS weight
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / weight AS key FROM r),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM k GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2 * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over,
         (sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws, row_number() OVER f AS place
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
o AS (SELECT place AS p0, left_over AS l0, ws AS w0 FROM l WHERE w * left_over < 2 * source_size * ws ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN p0 IS NOT NULL AND place >= p0 THEN w * l0 / w0 ELSE (2 * source_size)::DOUBLE END AS target FROM l LEFT JOIN o ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
c AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       least(size * (epochs + CASE WHEN rest > 0 AND rest - (upto - size) >= size / 2 THEN 1 ELSE 0 END), 2 * size)::BIGINT AS taken
FROM c
"""
