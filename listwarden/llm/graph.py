"""Connected components of link tables by alternating stars; no adjacency list, label or link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours under the smallest node that a node knows: the larger ones (large) or the smaller ones."""
    if large:
        seen = edges.union(edges.select("b", "a"))          # every node with all its neighbours
        least = stored(seen.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        moved = edges.join(least, "a").select("b", "low")   # a < b: neighbours larger than a
    else:
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))   # every node with its smaller neighbours
        least = stored(turned.groupBy("a").agg(F.min("b").alias("low")))
        moved = turned.join(least, "a").select("b", "low").union(least.select("a", "low"))
    out = stored(moved.toDF("b", "a").filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected links (a, b); component is its smallest node.

    Loops until nothing moves; the number of rounds grows with the logarithm of the longest path. Links of a node with
    itself and repeated links do no harm; nodes without links are not listed; no links give no rows.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while (now := _mark(edges)) != before:
        before = now
        wide = _star(edges, large=True)
        discard(edges)
        edges = _star(wide, large=False)
        discard(wide)
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stored(stars.union(edges.select("a", "a").distinct()))
