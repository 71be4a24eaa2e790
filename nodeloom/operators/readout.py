"""Sums and means over the rows of a graph, types of atoms, bonds and angles, and statistics of contributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .selection import chosen, draw_orders, thresholds, value_order
from .training_windows import running_sum


def grouped(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, values): the values of each group in the stated order."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("p")).select(group, F.col("p.v").alias("values"))


def scattered(rows: DataFrame, group: str, value: str, how: str | Callable[[Column], Column] = "sum") -> DataFrame:
    """(group, value): a reduction per group, by the name of an aggregate function or as a function of a column, such as a grouped pandas UDF."""
    reduce = getattr(F, how) if isinstance(how, str) else how
    return rows.groupBy(group).agg(reduce(F.col(value)).alias("value"))


def stacked(atoms: DataFrame | None, bonds: DataFrame | None, angles: DataFrame | None) -> DataFrame:
    """The rows of all kinds (gid, local_id, value array) with their kind."""
    parts = [df.select("gid", F.lit(kind).alias("kind"), "local_id", "value") for kind, df in (("atom", atoms), ("bond", bonds), ("angle", angles)) if df is not None]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def readout(rows: DataFrame, how: str = "mean", keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """(keys.., dim, value): the mean or sum of all rows of a graph, whatever their kind, in every dimension."""
    each = rows.select(*keys, F.posexplode("value").alias("dim", "x"))
    return each.groupBy(*keys, "dim").agg((F.avg("x") if how == "mean" else F.sum("x")).alias("value"))


def accumulated(rows: DataFrame, tag: str = "exact") -> DataFrame:
    """Predictions from contributions: "exact" sums per graph and output, "sum" per output over all graphs."""
    if tag == "exact":
        return readout(rows, "sum")
    if tag == "sum":
        return readout(rows, "sum", ())
    if tag == "ensemble":
        raise NotImplementedError("ensemble predictions are not defined")
    raise ValueError(f"no such accumulation: {tag}")


def distinct_lists(rows: DataFrame, value: str, order: str, fold: bool = True) -> DataFrame:
    """rows with key and type_id: lists that are equal, or with fold equal as sets with repeats, share a type, numbered from 0 by first appearance."""
    keyed = rows.withColumn("key", F.array_sort(value) if fold else F.col(value))
    kinds = keyed.groupBy("key").agg(F.min(order).alias("first"))  # one row per type
    firsts = running_sum(kinds.groupBy("first").agg(F.count("*").alias("n")), "n", "first").select("first", (F.col("upto") - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("first").orderBy("key")) - 1  # of types that appear at the same place
    kinds = kinds.withColumn("number", number).join(firsts, "first").select("key", (F.col("before") + F.col("number")).cast("int").alias("type_id"))
    return keyed.join(kinds, "key")


def bond_types(edges: DataFrame, nodes: DataFrame, species: str = "symbol", keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """edges with type_key: the two species, in alphabetical order."""
    end = lambda n: nodes.select(*keys, F.col("node_id").alias(n), F.col(species).alias(f"{n}_species"))
    met = edges.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"])
    return met.withColumn("type_key", F.array_sort(F.array("src_species", "dst_species"))).drop("src_species", "dst_species")


def angle_types(angles: DataFrame, edges: DataFrame, nodes: DataFrame, species: str = "symbol", keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """angles with type_key: the species of edge_u's start, the center and edge_v's start; mirror images are different types."""
    start = lambda n: edges.select(*keys, F.col("edge_id").alias(f"edge_{n}"), F.col("src").alias(f"{n}_node"), *([F.col("dst").alias("center")] if n == "u" else []))
    of = lambda n, name: nodes.select(*keys, F.col("node_id").alias(n), F.col(species).alias(name))
    met = angles.join(start("u"), [*keys, "edge_u"]).join(start("v"), [*keys, "edge_v"])
    met = met.join(of("u_node", "s1"), [*keys, "u_node"]).join(of("center", "s2"), [*keys, "center"]).join(of("v_node", "s3"), [*keys, "v_node"])
    return met.withColumn("type_key", F.array("s1", "s2", "s3")).drop("u_node", "v_node", "center", "s1", "s2", "s3")


def contribution_ratios(rows: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """rows (keys.., kind, local_id, value array, ..) with a row for each dim, its x, the total of the graph's prediction there, and ratio, the share of it; other columns stay."""
    others = [c for c in rows.columns if c != "value"]
    each = rows.select(*others, F.posexplode("value").alias("dim", "x"))
    total = F.sum("x").over(Window.partitionBy(*keys, "dim"))
    return each.withColumn("total", total).withColumn("ratio", F.col("x") / F.nullif("total", F.lit(0.0)))


def type_statistics(rows: DataFrame, keys: tuple[str, ...] = ("gid", "kind", "type_key"), value: str = "ratio") -> DataFrame:
    """(keys.., n, mean, std): population standard deviation."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def total_statistics(stats: DataFrame, keys: tuple[str, ...] = ("kind", "type_key"), order: str = "gid") -> DataFrame:
    """(keys.., means): the mean of each graph that has the type."""
    return stats.where("mean IS NOT NULL").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("mean").alias("m")))), lambda p: p["m"]).alias("means"))


def lowest_share_mean(rows: DataFrame, keys: tuple[str, ...], value: str, share: float = 0.25) -> DataFrame:
    """(keys.., low_mean): the mean of the lowest share of the values, the number rounded down; null if that leaves none. Null values don't count."""
    v = F.col(value).cast("double")
    slim = stored(rows.select(*keys, v.alias("v"), value_order(v).alias("o")), "values")  # each step reads the order
    ends = thresholds(slim, F.col("o"), lambda n: F.floor(n * share), keys, F.col("v"))
    return ends.select(*keys, ((F.col("__sel_sum") + F.col("__sel_rest") * F.col("__sel_value")) / F.nullif(F.col("__sel_below") + F.col("__sel_rest"), F.lit(0))).alias("low_mean"))


def extremes(rows: DataFrame, value: str, share: float, keys: tuple[str, ...] = (), id_col: str | None = None) -> DataFrame:
    """rows among the lowest or highest share, with side; low where both hold. Of equal values those whose id comes first in a draw go first, or without id_col any. Null values don't count."""
    ties = draw_orders(id_col, 0) if id_col else []
    order, wanted = value_order(F.col(value)), lambda n: F.floor(n * share)
    low = chosen(rows, [order, *ties], wanted, keys, "__sel_low")
    both = chosen(low, [F.bitwise_not(order), *ties], wanted, keys, "__sel_high")
    return both.where("__sel_low OR __sel_high").withColumn("side", F.when(F.col("__sel_low"), "low").otherwise("high")).drop("__sel_low", "__sel_high")


def part_of(elements: DataFrame, amounts: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """elements with part_id: the part that an ordinal falls into, from amounts (part_id, n) laid end to end.

    Ordinals and parts meet in stretches about as long as the parts are on
    average: a part is in all that it reaches, so there are at most two rows
    per part, and the join is one of equal numbers.
    """
    ends = running_sum(amounts.where("n > 0"), "n", "part_id", "stop").withColumn("start", F.col("stop") - F.col("n")).select("part_id", "start", "stop")
    total, parts = amounts.agg(F.sum("n"), F.count("*")).first()
    width = max(1, -(-int(total or 0) // max(1, parts)))
    at = lambda c: F.floor(c / F.lit(width)).cast("long")
    reach = ends.withColumn("stretch", F.explode(F.sequence(at(F.col("start")), at(F.col("stop") - 1))))
    met = elements.withColumn("stretch", at(F.col(ordinal))).join(reach, "stretch")
    return met.where((F.col(ordinal) >= F.col("start")) & (F.col(ordinal) < F.col("stop"))).drop("start", "stop", "stretch")


def parameter_summary(weights: DataFrame) -> DataFrame:
    """(layer, parameters): per layer, and in all where layer is null, from weights (layer, .., values array)."""
    return weights.rollup("layer").agg(F.sum(F.size("values")).alias("parameters"))
