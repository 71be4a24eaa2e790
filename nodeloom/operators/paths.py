"""Paths through a point cloud, the coordinate of points along them, and its smoothing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basis import cosine_cutoff
from ..functions.vectors import distance
from ..storage import cut as stored_cut
from ..storage import stored
from . import mixture
from .neighbors import k_nearest_nodes, knn, nearest_node
from .training_windows import running_sum


def boundary_mean(points: DataFrame, first: int = 0, last: int = 0, order: str = "id", vec: str = "x") -> DataFrame:
    """(dim, value): the mean of the first or last points by order."""
    edge = points.orderBy(F.col(order)).limit(first) if first else points.orderBy(F.col(order).desc()).limit(last)
    return edge.select(F.posexplode(vec).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("value"))


def centroids(points: DataFrame, bin_col: str = "bin", vec: str = "x") -> DataFrame:
    """(bin, x): the mean of each bin that isn't empty."""
    means = points.select(bin_col, F.posexplode(vec).alias("dim", "v")).groupBy(bin_col, "dim").agg(F.avg("v").alias("m"))
    return means.groupBy(bin_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("x"))


def greedy_path(first: np.ndarray, there: np.ndarray, start: int, stop: int) -> np.ndarray | None:
    """From start always to the nearest neighbor not yet visited, back a step where there is none; None if stop isn't reached. The neighbors of node i are there[first[i] : first[i + 1]], the nearest first."""
    path, seen, at = [start], np.zeros(len(first) - 1, bool), first[:-1].copy()  # at: neighbors before it are seen, and stay so
    seen[start] = True
    while path and path[-1] != stop:
        here = path[-1]
        i, end = int(at[here]), int(first[here + 1])
        while i < end and seen[there[i]]:
            i += 1
        at[here] = i
        if i == end:
            path.pop()
        else:
            path.append(int(there[i]))
            seen[path[-1]] = True
    return np.array(path) if path else None


def linked(near: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, there) of edges (src, dst, dist) taken both ways, as greedy_path() wants them: each node's list is sorted in Spark, and what reaches the driver is 8 bytes an entry, of which it keeps 4."""
    both = near.select("src", "dst", "dist").unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    lists = both.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "dst"))), lambda n: n["dst"]).alias("there"))
    ids, sizes, there = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in lists.toArrow().to_batches():
        ids.append(batch.column("src").to_numpy())
        sizes.append(np.diff(batch.column("there").offsets.to_numpy()))
        there.append(batch.column("there").flatten().to_numpy())
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    order = np.argsort(ids)
    first = np.concatenate([[0], np.cumsum(sizes)])
    # The lists stay in the order they came in; places in that order name the nodes.
    there = [order[np.searchsorted(ids[order], t)].astype(np.int32) for t in there]
    return ids, first, np.concatenate(there)


def path_nodes(points: DataFrame, start: int, stop: int, k: int = 7, id_col: str = "id", vec: str = "x") -> DataFrame:
    """(order, node): a path from start to stop over the graph of the k nearest neighbors, k raised while there is none.

    The neighbors are found and sorted in parallel, twice as many whenever
    those found are not enough; the walk itself, of which each step depends on
    all before it, runs on the driver over 4 bytes for each neighbor.
    """
    import pyarrow as pa

    n = points.count()
    cloud = points.select(F.col(id_col).alias("node_id"), F.col(vec).alias("x"))
    found, known = None, 0
    for near in range(k, max(n, k + 1)):
        if near > known:
            known = min(max(near, 2 * known), max(near, n - 1))
            found = stored(knn(cloud, min(known, n - 1)), "near")
        ids, first, there = linked(found.where(F.col("rank") <= near))
        ends = [np.flatnonzero(ids == i) for i in (start, stop)]
        path = greedy_path(first, there, int(ends[0][0]), int(ends[1][0])) if all(map(len, ends)) else None
        if path is not None:
            return points.sparkSession.createDataFrame(pa.table({"order": pa.array(np.arange(len(path), dtype=np.int32)), "node": pa.array(ids[path])}))
    raise ValueError("no path joins both ends, whatever the number of neighbors")


def path_distances(path: DataFrame, vec: str = "x", order: str = "order", legacy: bool = False) -> DataFrame:
    """path with gamma: the share of its length up to each node. legacy: counted from the last node to the first and on."""
    run = Window.orderBy(order)  # one row per path node
    before = F.lag(vec).over(run)
    if legacy:
        before = F.coalesce(before, F.last(vec).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    step = F.coalesce(distance(F.col(vec), before), F.lit(0.0))
    passed = path.withColumn("step", step).withColumn("passed", F.sum("step").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return passed.withColumn("gamma", F.col("passed") / F.nullif(F.max("passed").over(Window.partitionBy()), F.lit(0.0))).drop("step", "passed")


#: Nodes of a path that one task takes in order.
SHORT = 10_000


def distances_along(path: DataFrame, vec: str = "x", order: str = "order", legacy: bool = False) -> DataFrame:
    """As path_distances(), for paths of any length: nodes are numbered by running sums in two levels, meet the one before by number, and no task sees all."""
    columns = path.columns
    numbered = stored(running_sum(path.withColumn("__one", F.lit(1)), "__one", order, "__i").drop("__one"), "path")
    n = numbered.count()
    after = F.when((F.col("__i") < n) | F.lit(not legacy), F.col("__i") + 1).otherwise(1)
    before = numbered.select(after.alias("__i"), F.col(vec).alias("__before"))
    steps = numbered.join(before, "__i", "left").withColumn("__step", F.coalesce(distance(F.col(vec), F.col("__before")), F.lit(0.0)))
    passed = stored(running_sum(steps.select(*columns, "__step"), "__step", order, "__passed"), "path")
    whole = passed.agg(F.max("__passed")).first()[0]
    return passed.select(*columns, (F.col("__passed") / F.nullif(F.lit(whole).cast("double"), F.lit(0.0))).alias("gamma"))


def latent_path(points: DataFrame, start: int, stop: int, k: int = 7, version: str = "1", reduction: float = 1.0, legacy: bool = False, id_col: str = "id", vec: str = "x") -> DataFrame:
    """(order, x, gamma): a path through the cloud.

    Version 1 has the points visited; 2 takes every so many of them, assigns
    all points to the nearest and has the means; 3 has the means of the
    visited points from step to step.
    """
    path = path_nodes(points, start, stop, k, id_col, vec)
    located = path.join(points.select(F.col(id_col).alias("node"), F.col(vec).alias("x")), "node").select("order", "node", "x")
    length = path.count()
    along = distances_along if length > SHORT else path_distances
    if version == "1":
        return along(located.select("order", "x"), legacy=legacy)
    every = max(1, math.ceil(reduction * length)) if reduction < 1 else 1
    if version == "2":
        kept = located.where(F.col("order") % every == 0)
        near = nearest_node(points, kept.select("order", F.col("order").alias("node"), "x"), point=id_col, vec=vec)
        means = centroids(points.join(near, id_col).withColumnRenamed("node", "bin"), vec=vec)
    elif version == "3":
        means = centroids(located.withColumn("bin", F.floor(F.col("order") / every).cast("int")))
    else:
        raise ValueError(f"no such version: {version}")
    return along(means.select(F.col("bin").alias("order"), "x"), legacy=legacy)


def path_coordinate(points: DataFrame, path: DataFrame, id_col: str = "id", vec: str = "x") -> DataFrame:
    """(id, node, dist, gamma): the nearest node of path (order, x, gamma) and its coordinate."""
    near = nearest_node(points, path.select("order", F.col("order").alias("node"), "x"), point=id_col, vec=vec)
    return near.join(path.select(F.col("order").alias("node"), "gamma"), "node").select(id_col, "node", "dist", "gamma")


def assign_gammas(points: DataFrame, path: DataFrame, version: str = "1", k: int = 1, iterations: int = 1, cutoff: float = 10.0, id_col: str = "id", vec: str = "x") -> DataFrame:
    """(id, gamma). Version 1: of the nearest path node at a distance above 0; 2: the mean over the k nearest of gamma weighed by a cosine of the distance.

    With more iterations, version 2 goes on over the points' own neighbors;
    version 1 would only repeat itself and is refused.
    """
    if iterations > 1 and version == "1":
        raise ValueError("version 1 has nothing to iterate")
    path = stored_cut(path)  # read several times, as small as it may be beside what it is made of
    near = k_nearest_nodes(points, path.select(F.col("order").alias("node"), "x"), 1 if version == "1" else k, point=id_col, vec=vec)
    near = near.join(path.select(F.col("order").cast("long").alias("node"), "gamma"), "node")
    if version == "1":
        return near.select(id_col, "gamma")
    gammas = near.groupBy(id_col).agg(F.greatest(F.lit(0.0), F.avg(cosine_cutoff(F.col("dist"), cutoff) * F.col("gamma"))).alias("gamma"))
    return smooth(points, gammas, k, iterations - 1, cutoff, id_col, vec) if iterations > 1 else gammas


def smooth(points: DataFrame, gammas: DataFrame, k: int = 2, iterations: int = 1, cutoff: float = 10.0, id_col: str = "id", vec: str = "x", cut=stored_cut) -> DataFrame:
    """(id, gamma): iterations times the sum of gamma over a point and its k nearest, weighed by a cosine of the distance, over k + 1. cut: ends the lineage after a round."""
    near = knn(points.select(F.col(id_col).alias("node_id"), F.col(vec).alias("x")), k, include_self=True)
    near = near.withColumn("w", F.when(F.col("dist") < 1e-3, 1.0).otherwise(cosine_cutoff(F.col("dist"), cutoff))).select("src", "dst", "w")
    near = cut(near) if iterations > 1 else near  # read in every round
    for i in range(iterations):
        gammas = near.join(gammas.select(F.col(id_col).alias("dst"), "gamma"), "dst").groupBy(F.col("src").alias(id_col)).agg((F.sum(F.col("w") * F.col("gamma")) / (k + 1)).alias("gamma"))
        gammas = cut(gammas) if i + 1 < iterations else gammas
    return gammas


def standardized(points: DataFrame, id_col: str = "id", vec: str = "x") -> DataFrame:
    """points with vec less its mean, over its population standard deviation (1 where that is 0)."""
    each = points.select(F.posexplode(vec).alias("dim", "v"))
    stats = each.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = sorted(stats.collect())  # one row per dimension
    mean, scale = F.array(*(F.lit(r["m"]) for r in rows)), F.array(*(F.lit(r["s"] or 1.0) for r in rows))
    centered = F.zip_with(vec, mean, lambda x, m: x - m)
    return points.withColumn(vec, F.zip_with(centered, scale, lambda x, s: x / s) if rows else F.col(vec))


def principal_axes(points: DataFrame, dims: int, vec: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(axes, variances): the dims directions of largest variance, a column each, the largest entry of each positive, so that results can be compared. One pass sums products of coordinates; what reaches the driver is as large as their matrix."""
    d = points.where(F.col(vec).isNotNull()).select(F.size(vec)).first()[0]
    ((n, offsets, products),), _, _ = mixture.sums(points, mixture.Mixture(np.ones(1), np.zeros((1, d)), np.eye(d)[None]), vec)
    variances, axes = np.linalg.eigh(products / n - np.outer(offsets / n, offsets / n))
    variances, axes = variances[::-1][:dims], axes[:, ::-1][:, :dims]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]), variances


def project(points: DataFrame, dims: int, vec: str = "x", reducer=None) -> DataFrame:
    """points with p: standardized and projected, by principal axes unless a reducer with fit(df) and transform(df) from the vector column __v to __p is given. Null vectors give null."""
    scaled = standardized(points, vec=vec)
    if reducer is not None:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        scaled = scaled.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>")))
        return reducer.fit(scaled).transform(scaled).withColumn("p", vector_to_array("__p")).drop("__v", "__p")
    axes, _ = principal_axes(scaled, dims, vec)
    sent = scaled.sparkSession.sparkContext.broadcast(axes)
    schema = T.StructType([*(f for f in scaled.schema.fields if f.name != "p"), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [None if x is None else np.array(x, float) @ sent.value for x in batch.column(vec).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return scaled.select(*schema.names[:-1]).mapInArrow(run, schema)
