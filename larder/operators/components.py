"""Connected components of a graph that is given as a table of edges.

Alternating large-star and small-star steps: every node hangs its larger neighbours, then itself, under the least node it
knows. The number of steps grows with the logarithm of the width of the widest component. All neighbours of one node never
meet in a task: the least neighbour comes from an aggregate that is combined before the shuffle and is joined back, so that
Spark can split the rows of a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.staging import release, stage


def _under_least(edges: DataFrame) -> DataFrame:
    """Large star: all larger neighbours of a node go under the least of its neighbours and itself."""
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("_least"))
    least = least.select("node", F.least("node", "_least").alias("_least"))
    larger = both.filter("other > node").join(least, "node")
    return larger.select(F.col("other").alias("hi"), F.col("_least").alias("lo"))


def _lift(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours go under the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("_least"))
    siblings = edges.join(least, "hi").filter("lo <> _least").select(F.col("lo").alias("hi"), F.col("_least").alias("lo"))
    return siblings.union(least.select("hi", F.col("_least").alias("lo")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node, which itself hangs under none."""
    twice = edges.groupBy("hi").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("hi")
    inner = edges.select("hi").join(edges.select(F.col("lo").alias("hi")), "hi", "left_semi")
    return twice.union(inner).isEmpty()


def components(edges: DataFrame, one: str, other: str) -> DataFrame:
    """``node`` and ``component``, the least node that can be reached, for all nodes of the edges.

    Edges may be repeated, point either way or join a node with itself; those with a null end are left out. Nodes are of
    any type with an order.
    """
    named = edges.select(
        F.greatest(one, other).alias("hi"), F.least(one, other).alias("lo"), (F.col(one) == F.col(other)).alias("_loop")
    )
    named = stage(named.filter(F.col("_loop").isNotNull()).distinct())
    stars = named.filter("NOT _loop").select("hi", "lo")
    last = None
    while not _are_stars(stars):
        stars, passed = stage(_lift(_under_least(stars).distinct()).distinct()), last
        if passed is not None:
            release(passed)
        last = stars
    below = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = stars.select("lo").distinct()
    alone = named.filter("_loop").select("hi").join(
        stars.select("hi").union(stars.select("lo")), "hi", "left_anti"
    )
    return below.union(roots.union(alone).select(F.col("lo").alias("node"), F.col("lo").alias("component")))
