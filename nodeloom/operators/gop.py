"""Graph order parameter: an entropy of weighted degrees, summed over the components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut as stored_cut
from .components import connected_components
from .neighbors import radius_graph

DIGITS = 9


def stars(edges: DataFrame, keys: tuple[str, ...], most: int = 1_000_000) -> DataFrame:
    """(keys.., src, dst) that join what edges join, fewer and shorter: each task joins the edges of its own graphs, up to most nodes at a time, and names the smallest node for every other."""
    names = [*keys, "src", "dst"]
    schema = edges.select(*names).schema

    def run(batches):
        import pyarrow as pa

        kinds = None
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def out():
            rows = [(*x[0], x[1], root(x)[1]) for x in parent if root(x) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names]
            for *key, u, v in zip(*(batch.column(c).to_pylist() for c in names)):
                key = tuple(key)
                a, b = ((key, n) for n in (u, v))
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b, key=lambda x: x[1])] = min(a, b, key=lambda x: x[1])
            if len(parent) >= most:
                yield out()
        if parent:
            yield out()

    return edges.select(*names).repartition(*keys).mapInArrow(run, schema)


def linked_components(edges: DataFrame, keys: tuple[str, ...], cut=stored_cut) -> DataFrame:
    """(keys.., node_id, component) of the nodes that an edge (keys.., src, dst) joins: all graphs are one to connected_components, their keys part of each node. Small graphs come to it as stars, which it only confirms; a graph of any size may take its rounds."""
    node = lambda c: F.struct(*keys, F.col(c).alias("node"))
    found = connected_components(stars(edges, keys).select(node("src").alias("u"), node("dst").alias("v")), cut)
    return found.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.node").alias("node_id"), F.col("component.node").alias("component"))


def order_parameter(nodes: DataFrame, edges: DataFrame, k: float = 1, keys: tuple[str, ...] = ("gid",), components: DataFrame | None = None, cut=stored_cut) -> DataFrame:
    """(keys.., gop) from nodes or groups (keys.., ..) and undirected edges (keys.., src < dst, weight).

    In every component the share p of nodes that have the same weighted degree
    gives p ln p + degree * p, their sum goes to the power k above 0, and the
    graph has the sum over its components; a node alone gives 0. Degrees are
    rounded to nine digits, so that equal ones meet whatever order they were
    summed in. components: of all nodes or of those with an edge.
    """
    if k <= 0:
        raise ValueError("the power must be above 0")
    names = list(keys)
    ends = edges.select(*names, F.col("src").alias("node_id"), "weight").unionByName(edges.select(*names, F.col("dst").alias("node_id"), "weight"))
    degrees = ends.groupBy(*names, "node_id").agg(F.round(F.sum("weight"), DIGITS).alias("degree"))
    components = linked_components(edges, keys, cut) if components is None else components
    own = components.join(degrees, [*names, "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    counts = own.groupBy(*names, "component", "degree").agg(F.count("*").alias("n"))
    # Nodes of one degree are summed up first, so a window sees a row per degree.
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*names, "component"))
    per = counts.withColumn("p", p).groupBy(*names, "component").agg(F.sum(F.col("p") * F.log("p") + F.col("degree") * F.col("p")).alias("entropy"))
    found = per.groupBy(*names).agg(F.sum(F.pow("entropy", F.lit(float(k)))).alias("gop"))
    return nodes.select(*names).distinct().join(found, names, "left").withColumn("gop", F.coalesce("gop", F.lit(0.0)))


def parameters(spark, cutoffs: list[float], interactions: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(float(c), a, b) for c in cutoffs for a, b in interactions], "cutoff double, a string, b string")


def pair_edges(atoms: DataFrame, cutoffs: list[float], interactions: list[tuple[str, str]], keys: tuple[str, ...] = ("gid",), method: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(groups, edges) per group, cutoff and interaction that has atoms of either species; edges have weight 1 / r where 0.01 < r < cutoff; no images.

    Neighbors are looked for once, at the largest cutoff; each pair then counts
    for the parameters that its distance and species fit.
    """
    params = F.broadcast(parameters(atoms.sparkSession, cutoffs, interactions))  # as many rows as were asked for
    inner = [*keys, "cutoff", "a", "b"]
    groups = atoms.select(*keys, "symbol").distinct().join(params, (F.col("symbol") == F.col("a")) | (F.col("symbol") == F.col("b"))).select(*inner).distinct()
    pairs = radius_graph(atoms, max(cutoffs), method=method, keys=keys, carry=("symbol",)).where("src < dst AND dist > 0.01")
    s1, s2 = F.col("src_symbol"), F.col("dst_symbol")
    species = ((s1 == F.col("a")) & (s2 == F.col("b"))) | ((s1 == F.col("b")) & (s2 == F.col("a")))
    edges = pairs.join(params, species & (F.col("dist") < F.col("cutoff")))
    return groups, edges.select(*inner, "src", "dst", (1 / F.col("dist")).alias("weight"))


def graph_pair_edges(nodes: DataFrame, edges: DataFrame, cutoffs: list[float], interactions: list[tuple[str, str]], keys: tuple[str, ...] = ("gid",), legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same from a graph's own edges: the shortest image of each pair, weight 1 / dist below the cutoff; beyond it none, or dist itself with legacy."""
    params = parameters(nodes.sparkSession, cutoffs, interactions)
    inner = [*keys, "cutoff", "a", "b"]
    chosen = nodes.join(F.broadcast(params), (F.col("symbol") == F.col("a")) | (F.col("symbol") == F.col("b"))).select(*inner, "node_id", "symbol")
    pairs = edges.where("src <> dst").groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("dist").alias("dist"))
    end = lambda n: chosen.select(*inner, F.col("node_id").alias(n), F.col("symbol").alias(f"s_{n}"))
    met = pairs.join(end("src"), [*keys, "src"]).join(end("dst"), [*inner, "dst"])
    species = ((F.col("s_src") == F.col("a")) & (F.col("s_dst") == F.col("b"))) | ((F.col("s_src") == F.col("b")) & (F.col("s_dst") == F.col("a")))
    weight = F.when(F.col("dist") < F.col("cutoff"), 1 / F.col("dist"))
    weight = weight.otherwise(F.col("dist")) if legacy else weight
    found = met.where(species).select(*inner, "src", "dst", weight.alias("weight")).where("weight IS NOT NULL")
    return chosen.drop("symbol"), found


def predict(atoms: DataFrame, cutoffs: list[float], interactions: list[tuple[str, str]], k: float = 1, keys: tuple[str, ...] = ("gid",), edges: DataFrame | None = None, cut=stored_cut) -> DataFrame:
    """(keys.., cutoff, a, b, gop) from positions, or from a graph's edges if given; only interactions of species that occur."""
    nodes, found = pair_edges(atoms, cutoffs, interactions, keys) if edges is None else graph_pair_edges(atoms, edges, cutoffs, interactions, keys)
    return order_parameter(nodes, cut(found), k, (*keys, "cutoff", "a", "b"), cut=cut)


def flattened(gops: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., features): one vector per snapshot, by cutoff and interaction."""
    item = F.array_sort(F.collect_list(F.struct("cutoff", "a", "b", "gop")))
    return gops.groupBy(*keys).agg(F.transform(item, lambda x: x["gop"]).alias("features"))
