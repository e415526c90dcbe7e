"""Connected components by random-priority contraction.

In each round every node points to the neighbour (or itself) of least random priority, and
edges are drawn between what their ends point to.  A constant share of the nodes goes in
each round whatever the shape of the graph, so long chains of ascending ids are no worse
than others.  Nothing but counts of edges reaches the driver.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """id, component_id (least id reachable) of each node that edges (a, b) name; nulls and loops are ignored."""
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while not e.isEmpty():
        seed = len(maps)
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = e.select(F.col("a").alias("id"), F.least(rank("a"), rank("b")).alias("r")).union(e.select(F.col("b").alias("id"), F.least(rank("a"), rank("b")).alias("r")))
        to = saved(ends.groupBy("id").agg(F.min("r").alias("r")).select("id", F.col("r.id").alias("to")))
        maps.append(to)
        one = e.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").select("b", "x")
        two = one.join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        e = saved(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))

    def through(found: DataFrame, to: DataFrame) -> DataFrame:
        return found.join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))

    root = saved(reduce(through, maps[1:], maps[0]))
    least = saved(root.groupBy("to").agg(F.min("id").alias("component_id")))
    return root.join(least, "to").select("id", "component_id")
