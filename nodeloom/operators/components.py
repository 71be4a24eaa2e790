"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut as stored_cut


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u above v, are stars: no node has two smaller neighbors, and no center has one. Then each center is its component's smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def connected_components(edges: DataFrame, cut=stored_cut, limit: int = 60) -> DataFrame:
    """(node, component) for every node that an edge (u, v) names; component is the smallest node it reaches.

    cut(df) computes a frame once and returns it without its history. Each
    round links the larger neighbors of every node to its smallest neighbor
    (large star), then all smaller ones (small star); it ends once all edges
    are stars, after about log2(nodes) rounds. Should limit rounds not be enough,
    it raises an error rather than return unfinished components. The joins are
    on nodes: that of a node with very many edges is split by adaptive
    execution, and minima are taken before the shuffle. Nodes may be of any
    type that has an order, structs too; null ends make no edge.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(limit):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("at")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = large.join(low, F.col("u") == F.col("at"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()
        edges = cut(small)
    else:
        if not _settled(edges):
            raise RuntimeError(f"components have not settled after {limit} rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def has_path(edges: DataFrame, pairs: DataFrame, cut=stored_cut) -> DataFrame:
    """pairs (a, b) with linked: whether a path over the edges (u, v), taken either way, joins both; a node always reaches itself."""
    found = connected_components(edges, cut)
    end = lambda n: found.select(F.col("node").alias(f"{n}_node"), F.col("component").alias(f"{n}_component"))
    met = pairs.join(end("a"), F.col("a") == F.col("a_node"), "left").join(end("b"), F.col("b") == F.col("b_node"), "left")
    linked = (F.col("a") == F.col("b")) | (F.col("a_component") == F.col("b_component"))
    return met.select(*pairs.columns, F.coalesce(linked, F.lit(False)).alias("linked"))
