"""Connected components of links by alternating star contractions, one written table per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.session import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns); root is the component's smallest node.

    Every node hooks to the smallest of its neighbours, first the larger nodes around it, then
    itself and the smaller ones; the number of steps grows with the logarithm of the
    component's size. Minima are partial aggregates, so a node with any share of all links is one row
    per task; joins back to it are split at run time.
    """
    a, b = links.columns[:2]
    u, v = F.greatest(a, b), F.least(a, b)
    edges = written(links.select(u.alias("u"), v.alias("v")).where("u > v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = written(small, "links")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
