"""Connected components by a distributed union-find: alternating star
operations on the edge table until every component is a star around its
smallest node.

Large star: every node connects its larger neighbours to its smallest one.
Small star: every node connects its smaller neighbours, and itself, to the
smallest of them. Minima are aggregated (map side first) and joined back, so a
node with very many links is never gathered in one task, and AQE splits its
rows in the join. Each round is written to the shared checkpoint folder, which
cuts the lineage and survives lost executors. The number of rounds grows with
the logarithm of a component's diameter.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is the smallest
    node of its component. NULL nodes and links to itself are no links."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(root, "hi")
                 .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")),
                                           F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                 .select("e.*").where("hi <> lo").distinct())
        edges = materialize(small, "links")
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
