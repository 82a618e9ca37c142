"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .shared import Scratch


def _tied(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours (all larger ones, or all smaller ones and itself) tied to its least neighbour or itself.

    A node with very many neighbours is dealt to several tasks.
    """
    if both:  # every edge seen from both ends; ties the larger neighbours
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # seen from the larger end
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = skew.hot(seen, ["u"]).joined(seen, least, "v")
    out = tied.where(F.col("v") > F.col("u") if both else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not both:
        out = out.unionByName(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge ends in a node that has no smaller neighbour, and no node has two."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("ups")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("ups")))
    seen = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.min("ups").alias("least"))
    return seen.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (its component's least node) for every node of edges (a, b), a written table, that is not a root itself.

    Alternates large and small stars until only stars are left: a number of rounds that is
    logarithmic in practice, each with work linear in the edges. Every step is written to
    the shared folder, and the one before it deleted; ``scratch`` gets the last one.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = Scratch(edges.sparkSession)
    while not _are_stars(edges):
        for both in (True, False):
            after = Scratch(edges.sparkSession)
            edges = after.written(_tied(edges, both), "edges")
            kept.clear()
            kept = after
    scratch.paths += kept.paths
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
