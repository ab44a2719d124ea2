"""Connected components of an edge table by alternating large and small stars.

Every round is a few joins and aggregations over the edges; nothing is collected. A node's neighbours are
never gathered in one place: only the smallest is, and that is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.session import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected to; for all nodes of edges ``(u, v)``.

    Edges from a node to itself and null ends are ignored; repeated edges and either direction are fine.
    """
    edges = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        before, edges = edges, materialize(_small(_large(edges)), "edges")
        discard(before)
        inner = edges.select(F.col("v").alias("u")).distinct()  # ends of edges that start edges themselves, or nodes with two edges
        twice = edges.groupBy("u").agg(F.count("*").alias("n"))
        if not twice.join(inner, "u", "left_semi").limit(1).count() and not twice.filter("n > 1").limit(1).count():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
