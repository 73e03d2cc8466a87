"""Connected components of a graph of long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every vertex passes its larger (or its other smaller) neighbours on to its smallest."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    # written: a join that reads an aggregate in place cannot split a vertex with very many neighbours
    least = stash(least.select("a", F.least("a", "least").alias("least")), "smallest")
    if large:
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for each vertex of ``edges`` (a, b: long) that is not a root itself.

    Large and small star rounds alternate until the edges stay: each vertex then hangs on its root. Each round is
    written to the shared folder; neighbours of a vertex are never gathered. Loops and repeated edges change nothing.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = stash(edges, "edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = tuple(mark)
        edges = stash(_stars(_stars(edges, True), False), "edges")
