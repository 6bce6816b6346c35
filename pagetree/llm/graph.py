"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _pointed(edges: DataFrame, larger: bool) -> DataFrame:
    """One round: link each node's larger (or smaller) neighbours to its smallest one.

    Only (node, smallest) goes against the edges, so a node with very many links is one row on one
    side of a join that adaptive execution can split.
    """
    sides = _neighbours(edges)
    if not larger:
        sides = sides.where("v < u")
    least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = sides.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node with a link and the smallest node reachable from it.

    ``edges`` has long columns ``u`` and ``v``; loops and repeats do no harm.  Alternating rounds
    over larger and smaller neighbours end, in a number of rounds that grows with the logarithm of
    the table, with every node linked to the smallest of its component.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = now
        edges = staged(_pointed(_pointed(edges, larger=True), larger=False))
