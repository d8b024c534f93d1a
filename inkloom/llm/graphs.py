"""Connected components of link tables by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

ROWS = 1 << 17  # rows of a table of a round in one file at least, if there are as many


def _kept(table: DataFrame, name: str, most: int) -> DataFrame:
    """The table written with a file per ROWS of the ``most`` rows that it can have: a round over few edges starts few tasks and files."""
    return written(table.coalesce(max(1, -(-most // ROWS))), name)


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step on at most ``n`` edges (a > b). Large: every larger neighbour of a node is linked to the node's least neighbour.
    Small: every smaller neighbour, and the node itself. Only minima are gathered per node; they are
    written so that the join has plain exchanges on both sides, which adaptive execution can split at a hub."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = _kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", 2 * n)
    met = both.join(least, "a")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any order-comparable node ids -> (node, component), component the least node reachable.

    Nulls and self-links are ignored; nodes without a link do not appear. The number of rounds grows with the
    logarithm of the longest chain; each round is written to the shared folder. A round ends the loop when neither
    star changed an edge: the count and an order-free hash of the edges are compared.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = written(ordered.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        # A large step makes an edge of an edge at most, a small one of an edge and of a node with one.
        edges = _kept(_star(_star(edges, True, state["n"]), False, state["n"]), "links", 2 * state["n"])
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
