"""Connected components of a graph held in DataFrames.

Rounds of contraction: each vertex points to its smallest neighbour, pointers
are followed once, and edges are rewritten to what their ends point to.  Nothing
is collected; a vertex with very many edges is one row after a partial minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def components(edges: DataFrame) -> DataFrame | None:
    """``v`` and ``root`` of every vertex of ``edges`` (``a``, ``b``); None without edges."""
    e = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")))
        again = first.select(F.col("a").alias("p"), F.col("p").alias("q"))
        point = written(first.join(again, "p", "left").select("a", F.coalesce("q", "p").alias("p")))
        old, was = labels, e
        if labels is None:
            labels = point.select(F.col("a").alias("v"), F.col("p").alias("root"))
        else:
            labels = labels.join(point, F.col("root") == F.col("a"), "left").select("v", F.coalesce("p", "root").alias("root"))
        labels = written(labels)
        left, right = point.select("a", F.col("p").alias("x")), point.select(F.col("a").alias("b"), F.col("p").alias("y"))
        e = written(e.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a != b").distinct())
        discard(first, point, old, was)
    discard(e)
    return labels
