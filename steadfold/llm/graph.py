"""Connected components of an edge table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfold.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every left end (sums up before the shuffle, so hubs are cheap)."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _settled(edges: DataFrame) -> bool:
    """Whether only stars are left: no node has two smaller neighbours, or both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    ends = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return ends.where("smaller > 1 or smaller = 1 and larger = 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge table; the root is the smallest node.

    Alternates large-star and small-star steps until only stars are left, so the number of rounds
    grows with the logarithm of the component size.  Each round is written to the shared
    folder.  Null ends and loops are ignored; an empty table has no components.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = both.join(_least(both), "u").where("v > u").select(
            F.col("v").alias("u"), F.least("u", "least").alias("v")).where("u <> v")
        low = star.join(_least(star), "u")
        star = low.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            low.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        edges = materialize(star, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
