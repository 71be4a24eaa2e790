"""Stratified samples: clusters, a quota from each, and what is left.

Each sampler returns its input with cluster and sampled. The order in which
rows are drawn is that of md5(seed:id), so reruns and other engines agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, stored
from . import birch, mixture, spectral
from .components import connected_components
from .neighbors import knn
from .selection import DRAW_STEPS, chosen, draw_orders


def first_rows(df: DataFrame, n: int | Callable[[Column], Column], id_col: str, seed: int, per: tuple[str, ...] = (), name: str = "drawn", among: Column | None = None) -> DataFrame:
    """df with name: whether a row is among the first n of the draw, in all or of each value of the columns per; n may be a function of the number of rows. among: only rows for which it holds are drawn from.

    Nothing is ranked: histograms of the hashes tell where the draw ends.
    Exactly n rows are drawn, as far as there are so many.
    """
    wanted = n if callable(n) else lambda total: F.lit(n)
    return chosen(df, draw_orders(id_col, seed), wanted, per, name, among, DRAW_STEPS)


def random_sample(df: DataFrame, split: float, seed: int = 0, count: int = 0, id_col: str = "id") -> DataFrame:
    share = lambda total: F.lit(count) if count else F.ceil(F.lit(split) * total)
    return first_rows(df.withColumn("cluster", F.lit(0)), share, id_col, seed, name="sampled")


def by_quota(df: DataFrame, split: float, seed: int = 0, id_col: str = "id", clusters: int | None = None) -> DataFrame:
    """df (cluster, ..) with sampled: ceil(split * n / clusters) rows of every cluster, small clusters whole, then more from the rest up to ceil(split * n)."""
    sizes = stored(df.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    n, found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    quota = math.ceil(split * n / (clusters or max(1, found)))
    drawn = sizes.agg(F.sum(F.least("n", F.lit(quota)))).first()[0] or 0
    picked = first_rows(df, quota, id_col, seed, ("cluster",), "sampled")
    missing = math.ceil(split * n) - drawn
    if missing <= 0:
        return picked
    more = first_rows(picked, missing, id_col, seed + 1, name="__sel_more", among=~F.col("sampled"))
    return more.withColumn("sampled", F.col("sampled") | F.col("__sel_more")).drop("__sel_more")


def by_property(df: DataFrame, value: str, clusters: int, split: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Clusters are bins of a value: the number of evenly spaced edges strictly below it."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = (high - low) / (clusters - 1) if clusters > 1 and low is not None and high > low else 1.0
    cluster = F.when(F.col(value) <= F.lit(low), 0).otherwise(F.ceil((F.col(value) - F.lit(low)) / F.lit(width))).cast("int")
    return by_quota(df.withColumn("cluster", cluster), split, seed, id_col)


def by_grid(df: DataFrame, grids: int, split: float, columns: tuple[str, ...], seed: int = 0, id_col: str = "id") -> DataFrame:
    """Clusters are cells of a mesh with grids cells a side and one more around it."""
    bounds = df.agg(*(f(c) for c in columns for f in (F.min, F.max))).first()
    cluster = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        low, high = bounds[2 * i], bounds[2 * i + 1]
        width = (high - low) / grids if low is not None and high > low else 1.0
        cell = F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(grids - 1)) + 1
        cluster = cluster * (grids + 2) + cell
    return by_quota(df.withColumn("cluster", cluster.cast("long")), split, seed, id_col)


def by_subgraph(df: DataFrame, neighbors: int, split: float, seed: int = 0, id_col: str = "id", vec: str = "x", cut=cut) -> DataFrame:
    """Clusters are the components of the graph of nearest neighbors."""
    edges = knn(df.select(F.col(id_col).alias("node_id"), F.col(vec).alias("x")), neighbors).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    found = connected_components(edges, cut)
    named = df.join(found, F.col(id_col) == F.col("node"), "left").withColumn("cluster", F.coalesce("component", F.col(id_col).cast("long"))).drop("node", "component")
    return by_quota(named, split, seed, id_col)


def by_model(df: DataFrame, method: str, clusters: int | None, split: float, seed: int = 0, id_col: str = "id", vec: str = "x", restarts: int = 10, **params) -> DataFrame:
    """Clusters of a fitted model: kmeans (the best of restarts), gaussian_mixture, birch or spectral; params go to the last three. Rows without a vector are cluster 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if method == "spectral":
        found = spectral.clusters_of(df, clusters, seed=seed, id_col=id_col, vec=vec, **params).withColumnsRenamed({id_col: "__i", "cluster": "__c"})
        named = df.drop("cluster").join(found, F.col(id_col) == F.col("__i"), "left").withColumn("cluster", F.col("__c")).drop("__i", "__c")
    elif method == "gaussian_mixture":
        named = mixture.assigned(df, mixture.fit(df, clusters, seed, vec, **params)[0], vec)
    elif method == "birch":
        named = birch.assigned(df, clusters, vec=vec, **params)
    elif method == "kmeans":
        data = df.drop("cluster").withColumn("__v", array_to_vector(F.col(vec).cast("array<double>")))
        models = [KMeans(k=clusters, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(data) for i in range(restarts)]
        named = min(models, key=lambda m: m.summary.trainingCost).transform(data).drop("__v")
    else:
        raise ValueError(f"no such clustering: {method}")
    return by_quota(named.withColumn("cluster", F.coalesce("cluster", F.lit(0))), split, seed, id_col)


def sample(df: DataFrame, method: str, split: float, seed: int = 0, **params) -> DataFrame:
    """Any of the samplers by name; sampled rows and the others together are the input."""
    if method == "random":
        return random_sample(df, split, seed, **params)
    if method == "property_binning":
        return by_property(df, split=split, seed=seed, **params)
    if method == "grid":
        return by_grid(df, split=split, seed=seed, **params)
    if method == "subgraph":
        return by_subgraph(df, split=split, seed=seed, **params)
    return by_model(df, method, split=split, seed=seed, **params)


def three_way(df: DataFrame, test: float, pretrain: float, train: float, seed: int = 0, method: str = "random", id_col: str = "id", **params) -> DataFrame:
    """df with role: test first, then pretrain from what is left, then training, and validation for the rest."""
    columns, left, roles = [c for c in df.columns if c != "role"], df, None
    for i, (name, split) in enumerate((("test", test), ("pretrain", pretrain), ("training", train))):
        drawn = sample(left, method, split, seed + i, id_col=id_col, **params)
        part = drawn.where("sampled").select(*columns, F.lit(name).alias("role"))
        roles = part if roles is None else roles.unionByName(part)
        left = drawn.where("NOT sampled").select(*columns)
    return roles.unionByName(left.withColumn("role", F.lit("validation")))
