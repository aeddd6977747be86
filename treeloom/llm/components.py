"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the smaller and own) neighbours of every node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    tied = both.join(least, "u")
    if large:
        tied = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        tied = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    return tied.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every node of edges (u, v) the smallest node that it reaches.

    The neighbourhood minimum is aggregated before its shuffle, so a node with very many neighbours costs one row a
    task there; each round is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    at = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        mark = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return at.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = mark
        if mark[0] == 0:
            continue
        at, old = materialize(_star(_star(at, True), False)), at
        discard(old)
