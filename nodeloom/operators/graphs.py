"""Graphs of atoms and bonds, their line graphs, and graphs around single atoms.

Tables: nodes (gid, node_id, ..), edges (gid, edge_id, src, dst, dist, dx, dy,
dz), angles (gid, angle_id, edge_u, edge_v, angle, is_dihedral).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle3, dihedral3
from ..functions.vectors import angle_between, minus
from .neighbors import edges_from_neighbors, radius_graph
from .training_windows import running_sum


def with_edge_ids(edges: DataFrame, keys: tuple[str, ...] = ("gid",), order: tuple[str, ...] = ("src", "dst", "sx", "sy", "sz")) -> DataFrame:
    """edges numbered from 0 in every group, in the stated order."""
    chosen = [c for c in order if c in edges.columns]
    return edges.withColumn("edge_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*chosen)) - 1)


def with_edge_ids_of_one(edges: DataFrame, order: tuple[str, ...] = ("dst",)) -> DataFrame:
    """edges of one large graph numbered from 0 by src and the stated order: within every src, on top of the number of edges from smaller ones, so that no task sorts all of them. src must be a number."""
    counts = running_sum(edges.groupBy("src").agg(F.count("*").alias("__n")), "__n", "src", "__upto")
    number = F.row_number().over(Window.partitionBy("src").orderBy(*order)) - 1
    before = counts.select(F.col("src").alias("__src"), (F.col("__upto") - F.col("__n")).alias("__before"))
    return edges.withColumn("edge_id", number).join(before, F.col("src") == F.col("__src")).withColumn("edge_id", F.col("edge_id") + F.col("__before")).drop("__src", "__before")


def line_graph(edges: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., edge_u, edge_v): ordered pairs of different edges into the same node, d * (d - 1) for a node with d."""
    u = edges.select(*keys, "dst", F.col("edge_id").alias("edge_u"))
    v = edges.select(*keys, "dst", F.col("edge_id").alias("edge_v"))
    return u.join(v, [*keys, "dst"]).where("edge_u <> edge_v").select(*keys, "edge_u", "edge_v")


def bond_angles(edges: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., edge_u, edge_v, angle, is_dihedral) of the line graph: radians at the node that both edges enter, between the images that the edges were made with."""
    side = lambda n: edges.select(*keys, "dst", F.col("edge_id").alias(f"edge_{n}"), *(F.col(f"d{c}").alias(f"{n}{c}") for c in "xyz"))
    pairs = side("u").join(side("v"), [*keys, "dst"]).where("edge_u <> edge_v")
    angle = angle3(tuple(F.col(f"u{c}") for c in "xyz"), tuple(F.col(f"v{c}") for c in "xyz"))
    return pairs.select(*keys, "edge_u", "edge_v", angle.alias("angle"), F.lit(False).alias("is_dihedral"))


def node_angles(edges: DataFrame, keys: tuple[str, ...] = ("gid",), carry: tuple[str, ...] = ()) -> DataFrame:
    """The angles of bond_angles() with columns of both edges as u_<column> and v_<column>, from a list of the edges into each node: where edges lie by their group, none moves. A node's edges must fit a row."""
    item = F.struct("edge_id", "dx", "dy", "dz", *carry)
    met = edges.groupBy(*keys, "dst").agg(F.collect_list(item).alias("__edges"))
    pairs = met.select(*keys, "__edges", F.explode("__edges").alias("u")).select(*keys, "u", F.explode("__edges").alias("v")).where("u.edge_id <> v.edge_id")
    angle = angle3(tuple(F.col(f"u.d{c}") for c in "xyz"), tuple(F.col(f"v.d{c}") for c in "xyz"))
    carried = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "uv" for c in carry]
    return pairs.select(*keys, F.col("u.edge_id").alias("edge_u"), F.col("v.edge_id").alias("edge_v"), angle.alias("angle"), F.lit(False).alias("is_dihedral"), *carried)


def three_body_angles(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("gid",), vec: str = "x", legacy_scale: bool = False) -> DataFrame:
    """The same for points of any dimension, nodes (keys.., node_id, vec). legacy_scale: multiplied by pi / 180 once more."""
    ends = edges.join(nodes.select(*keys, F.col("node_id").alias("src"), F.col(vec).alias("a")), [*keys, "src"]).join(nodes.select(*keys, F.col("node_id").alias("dst"), F.col(vec).alias("b")), [*keys, "dst"])
    arms = ends.select(*keys, "dst", "edge_id", minus(F.col("a"), F.col("b")).alias("arm"))
    u, v = (arms.select(*keys, "dst", F.col("edge_id").alias(f"edge_{n}"), F.col("arm").alias(n)) for n in "uv")
    angle = angle_between(F.col("u"), F.col("v"))
    pairs = u.join(v, [*keys, "dst"]).where("edge_u <> edge_v")
    return pairs.select(*keys, "edge_u", "edge_v", (angle * F.lit(math.pi / 180) if legacy_scale else angle).alias("angle"), F.lit(False).alias("is_dihedral"))


def dihedrals(edges: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., edge_u, edge_v, angle, is_dihedral) for every bond b -> c with neighbors a of b and d of c, all four different: edge_u is a -> b, edge_v is d -> c."""
    first = edges.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_id").alias("edge_u"), *(F.col(f"d{c}").alias(f"u{c}") for c in "xyz"))
    middle = edges.select(*keys, F.col("src").alias("b"), F.col("dst").alias("c"), *(F.col(f"d{c}").alias(f"m{c}") for c in "xyz"))
    last = edges.select(*keys, F.col("src").alias("d"), F.col("dst").alias("c"), F.col("edge_id").alias("edge_v"), *((-F.col(f"d{c}")).alias(f"v{c}") for c in "xyz"))
    chains = first.join(middle, [*keys, "b"]).where("a <> c").join(last, [*keys, "c"]).where("d <> b AND d <> a")
    vector = lambda n: tuple(F.col(n + c) for c in "xyz")
    return chains.select(*keys, "edge_u", "edge_v", dihedral3(vector("u"), vector("m"), vector("v")).alias("angle"), F.lit(True).alias("is_dihedral"))


def atomic_graph(atoms: DataFrame, cutoff: float, cell=None, periodic=(True, True, True), angles: bool = True, dihedral: bool = False, method: str = "auto", keys: tuple[str, ...] = ("gid",)) -> dict[str, DataFrame]:
    """nodes, edges and angles of atoms (keys.., node_id, symbol or z, x, y, z)."""
    edges = with_edge_ids(radius_graph(atoms, cutoff, cell, periodic, method=method, keys=keys), keys)
    out = {"nodes": atoms, "edges": edges}
    if angles:
        found = bond_angles(edges, keys)
        out["angles"] = found.unionByName(dihedrals(edges, keys)) if dihedral else found
    return out


def joined_graph(structures: list[DataFrame], cutoff: float, cell=None, periodic=(True, True, True), angles: bool = True, keys: tuple[str, ...] = ("gid",)) -> dict[str, DataFrame]:
    """One graph per gid from several structures of it: part_id says which one; node, edge and angle ids go on from part to part."""
    parts = None
    for i, atoms in enumerate(structures):
        part = atoms.withColumn("part_id", F.lit(i))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    inner = (*keys, "part_id")
    graph = atomic_graph(parts, cutoff, cell, periodic, angles, keys=inner)
    renumber = lambda df, name, order: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("part_id", *order)) - 1)
    nodes = renumber(graph["nodes"].withColumnRenamed("node_id", "local_node"), "node_id", ["local_node"])
    number = lambda end: nodes.select(*inner, F.col("local_node").alias(f"local_{end}"), F.col("node_id").alias(end))
    edges = graph["edges"].withColumnsRenamed({"src": "local_src", "dst": "local_dst", "edge_id": "local_edge"}).join(number("src"), [*inner, "local_src"]).join(number("dst"), [*inner, "local_dst"])
    edges = renumber(edges, "edge_id", ["local_edge"])
    out = {"nodes": nodes, "edges": edges.drop("local_src", "local_dst")}
    if angles:
        edge_of = lambda end: edges.select(*inner, F.col("local_edge").alias(f"local_{end}"), F.col("edge_id").alias(f"edge_{end}"))
        found = graph["angles"].withColumnsRenamed({"edge_u": "local_u", "edge_v": "local_v"}).join(edge_of("u"), [*inner, "local_u"]).join(edge_of("v"), [*inner, "local_v"])
        out["angles"] = renumber(found, "angle_id", ["local_u", "local_v", "is_dihedral"]).drop("local_u", "local_v")
    out["edges"] = out["edges"].drop("local_edge")
    return out


def ego_graphs(edges: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., center, edge_id, src, dst, dist, ..): around each atom its outgoing edges and their mirror images, nodes numbered from 0 as they first appear."""
    vector = [c for c in ("dx", "dy", "dz") if c in edges.columns]
    out = edges.select(*keys, F.col("src").alias("center"), F.lit(0).alias("mirrored"), F.col("edge_id").alias("of_edge"), "src", "dst", "dist", *vector)
    back = edges.select(*keys, F.col("src").alias("center"), F.lit(1).alias("mirrored"), F.col("edge_id").alias("of_edge"), F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", *((-F.col(c)).alias(c) for c in vector))
    both = out.unionByName(back)
    ego = [*keys, "center"]
    # The center appears first, the others by their edge.
    others = out.groupBy(*ego, F.col("dst").alias("node")).agg(F.min("of_edge").alias("first"))
    others = others.withColumn("local", F.row_number().over(Window.partitionBy(*ego).orderBy("first", "node"))).select(*ego, "node", "local")
    centers = out.select(*ego, F.col("center").alias("node"), F.lit(0).alias("local")).distinct()
    numbers = centers.unionByName(others.where("node <> center"))
    numbered = both.join(numbers.select(*ego, F.col("node").alias("src"), F.col("local").alias("new_src")), [*ego, "src"]).join(numbers.select(*ego, F.col("node").alias("dst"), F.col("local").alias("new_dst")), [*ego, "dst"])
    numbered = numbered.withColumn("edge_id", F.row_number().over(Window.partitionBy(*ego).orderBy("mirrored", "of_edge")) - 1)
    return numbered.select(*ego, "edge_id", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "dist", *vector)


def generic_graph(nodes: DataFrame, angles: bool = True, keys: tuple[str, ...] = ("gid",), one: bool = False) -> dict[str, DataFrame]:
    """A graph from points with lists of their neighbors: nodes (keys.., node_id, x, ind, dist). one: all points are one large graph."""
    found = edges_from_neighbors(nodes, keys)
    edges = with_edge_ids_of_one(found, ("rank",)) if one else with_edge_ids(found, keys, ("src", "rank"))
    out = {"nodes": nodes.drop("ind", "dist"), "edges": edges}
    if angles:
        out["angles"] = three_body_angles(edges, nodes, keys)
    return out


BUILDERS = {"atomic": atomic_graph, "joined": joined_graph, "generic": generic_graph}


def build(kind: str, *args, **kwargs) -> dict[str, DataFrame]:
    if kind not in BUILDERS:
        raise ValueError(f"no such kind of graph: {kind}")
    return BUILDERS[kind](*args, **kwargs)


def graph_id(edges: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., content_id): 128 hexadecimal digits that depend on the edges and distances alone, not on the order of rows."""
    item = F.concat_ws(":", "src", "dst", F.format_number("dist", 6))
    return edges.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ";"), 512).alias("content_id"))


def edge_vectors(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """edges with dx, dy, dz: the position of dst less that of src."""
    end = lambda n: nodes.select(*keys, F.col("node_id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    found = edges.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"])
    return found.select(*edges.columns, *((F.col(f"dst_{c}") - F.col(f"src_{c}")).alias(f"d{c}") for c in "xyz"))


def add_edges(edges: DataFrame, more: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """The union of both sets of (keys.., src, dst)."""
    return edges.select(*keys, "src", "dst").union(more.select(*keys, "src", "dst")).distinct()


def mask_edges(edges: DataFrame, subset: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """edges with masked: whether (src, dst) is in subset."""
    marked = subset.select(*keys, "src", "dst").distinct().withColumn("in_subset", F.lit(True))
    return edges.join(marked, [*keys, "src", "dst"], "left").withColumn("masked", F.coalesce("in_subset", F.lit(False))).drop("in_subset")


def same_rows(a: DataFrame, b: DataFrame, vec: str = "x", row: str = "id") -> DataFrame:
    """(a, b): ids of rows whose whole vectors are equal."""
    return a.select(F.col(row).alias("a"), F.col(vec).alias("x")).join(b.select(F.col(row).alias("b"), F.col(vec).alias("x")), "x").select("a", "b")


def index_to_mask(rows: DataFrame, index: DataFrame, row: str = "id") -> DataFrame:
    """rows with mask: whether the row's id is in index."""
    return rows.join(index.select(F.col(row)).distinct().withColumn("in_index", F.lit(True)), row, "left").withColumn("mask", F.coalesce("in_index", F.lit(False))).drop("in_index")


def mask_to_index(rows: DataFrame, row: str = "id", mask: str = "mask") -> DataFrame:
    return rows.where(F.col(mask)).select(row)
