"""Connected components of a graph given as pairs of ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace


def _toward_smallest(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Small star: link each node's smaller neighbours, and itself, to the smallest of them."""
    least = work.write(edges.groupBy("a").agg(F.min("b").alias("m")), f"{name}-small")
    own = least.select("a", F.col("m").alias("b"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionAll(moved).distinct()


def _toward_hub(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Large star: link each node's larger neighbours to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    least = work.write(least, f"{name}-large")
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return larger.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b) that is not the smallest of its component.

    ``component`` is the smallest id of the connected component. Edges may be
    repeated, of either direction or loops; null ends are ignored. Every round
    is written as a table, and the number of rounds grows with the logarithm of
    the longest path. A node with very many edges is one row per edge in joins
    that adaptive execution can split.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = work.write(ordered.distinct(), f"{name}-0")
    turn = 0
    while True:
        # A forest of stars: every node points to one other, which points nowhere.
        nodes = current.groupBy("a").agg(F.count("*").alias("n"))
        many = nodes.filter("n > 1").limit(1).count()
        if not many and not current.join(nodes.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
        turn += 1
        hub = work.write(_toward_hub(current, work, name), f"{name}-{turn}h")
        work.drop(f"{name}-{turn - 1}", f"{name}-large")
        current = work.write(_toward_smallest(hub, work, name), f"{name}-{turn}")
        work.drop(f"{name}-{turn}h", f"{name}-small")
