"""Connected components of a link table by alternating star contractions.

Each round first connects every node's larger neighbours to the smallest node
of its neighbourhood, then does the same with the smaller neighbours. Both are
grouped minima joined back on the node, so a hub's links are never gathered in
one task: the minimum combines before the shuffle and the join can be split.
The number of rounds grows with the logarithm of the longest chain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """Join every edge (u, v) with the smallest neighbour of u."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u")


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, center) for every node of ``links(a, b)``; the center is the smallest node reachable."""
    edges = (links.where("a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, round_, last = None, 0, None
    while True:
        if round_:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = (_star(both).withColumn("m", F.least("m", "u")).where("v > u and v <> m")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            low = _star(large)
            edges = (low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        table = f"{name}_{round_}"
        edges = scratch.save(edges, table)
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if last:
            scratch.drop(last)
        if seen == mark or not seen[0]:
            break
        mark, last, round_ = seen, table, round_ + 1
    centers = edges.select(F.col("u").alias("node"), F.col("v").alias("center"))
    return centers.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("center")).distinct())
