"""Connected components of an edge table, by alternating large and small stars.

A large star links every larger neighbour of a node to the smallest one, a small star every smaller
neighbour and the node itself. Both keep the components as they are and shrink their depth; when a
round changes nothing, every node hangs directly from the smallest node of its component. Rounds are
logarithmic in the size of a component. Edges are only joined with one row per node, minima are
combined before the shuffle, and the adaptive planner splits the rows of a node with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.sources.store import Scratch


def _downward(pairs: DataFrame) -> DataFrame:
    """Distinct pairs as (u, v) with u > v."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _downward(both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _downward(moved.unionByName(smallest.select("u", F.col("m").alias("v"))))


def _fingerprint(edges: DataFrame) -> tuple:
    """Tells two edge sets apart; one row, whatever their size."""
    pair = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(pair), F.sum(pair.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node in ``edges(u, v)``.

    Nodes are of one orderable type; the component is its smallest node. Loops, repeated and turned
    edges do no harm, edges with a NULL end are left out. No edges give no rows. Every round is
    stored, so that a lost executor costs one round.
    """
    current = scratch.keep(_downward(edges.where("u IS NOT NULL AND v IS NOT NULL")))
    state = _fingerprint(current)
    while state[0]:
        following = scratch.keep(_small_star(_large_star(current)))
        scratch.drop(current)
        current, previous, state = following, state, _fingerprint(following)
        if state == previous:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
