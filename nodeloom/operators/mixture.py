"""Gaussian mixtures with full covariances, fitted by expectation-maximisation over sums that Spark adds up.

A step reads the points once. Each partition sums, per component, how much of
its points belongs to it, their offsets from the component's mean and the
products of these; the sums are added in Spark, a row per component and
partition, and what reaches the driver is as large as the model. Covariances
have a prior, as if some more points of a small even spread lay around each
mean: they stay positive definite where a component has fewer points than
dimensions, and the objective (likelihood and prior) never falls.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points whose offsets are multiplied at a time.
ROWS = 4096


@dataclass(frozen=True)
class Mixture:
    """weights (k), means (k, d), covariances (k, d, d); spread and strength of the prior."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    spread: float = 1e-6
    strength: float = 1.0

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(n, k): the logarithm of weight times density of every point in every component."""
        out, d = np.empty((len(x), len(self.weights))), x.shape[1]
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            lower = np.linalg.cholesky(c)
            y = (x - m) @ np.linalg.inv(lower).T
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (y * y).sum(1) - np.log(np.diag(lower)).sum() - 0.5 * d * np.log(2 * np.pi)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, k) shares of the components in every point, and (n) the logarithm of its density."""
        logs = self.log_densities(x)
        top = logs.max(1, keepdims=True)
        shares = np.exp(logs - top)
        total = shares.sum(1, keepdims=True)
        return shares / total, (top + np.log(total))[:, 0]

    def log_prior(self) -> float:
        """Up to a constant, what the prior adds to the logarithm of the likelihood."""
        return sum(-0.5 * self.strength * (np.linalg.slogdet(c)[1] + self.spread * np.trace(np.linalg.inv(c))) for c in self.covariances) if self.strength else 0.0


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1 if len(column) else 0)


def sums(points: DataFrame, model: Mixture, vec: str = "x") -> tuple[list[tuple[float, np.ndarray, np.ndarray]], float, float]:
    """For each component the weight, sum of offsets and sum of their products; then the logarithm of the likelihood and the number of points."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    k, d = model.means.shape
    rows, columns = np.tril_indices(d)
    shipped = points.sparkSession.sparkContext.broadcast(model)  # as large as the model

    def add(batches):
        import pyarrow as pa

        model, total = shipped.value, np.zeros((k, 3 + d + len(rows)))
        for batch in batches:
            every = _vectors(batch.column("x"))
            for at in range(0, len(every), ROWS):
                x = every[at : at + ROWS]
                shares, logs = model.responsibilities(x)
                total[0, 1] += logs.sum()
                total[0, 2] += len(x)
                for i in range(k):
                    off = x - model.means[i]
                    own = off * shares[:, i : i + 1]
                    total[i, 0] += shares[:, i].sum()
                    total[i, 3 : 3 + d] += own.sum(0)
                    total[i, 3 + d :] += (own.T @ off)[rows, columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["component", "total"])

    partial = points.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("x")).mapInArrow(add, "component int, total array<double>")
    found = partial.select("component", array_to_vector("total").alias("total")).groupBy("component").agg(Summarizer.sum(F.col("total")).alias("total")).collect()  # a row per component
    out, logs, n = [(0.0, np.zeros(d), np.zeros((d, d)))] * k, 0.0, 0.0
    for component, total in found:
        t = total.toArray()
        products = np.zeros((d, d))
        products[rows, columns] = t[3 + d :]
        out[component] = (t[0], t[3 : 3 + d], products + np.tril(products, -1).T)
        logs, n = logs + t[1], n + t[2]
    return out, logs, n


def step(points: DataFrame, model: Mixture, vec: str = "x") -> tuple[Mixture, float, float]:
    """The model after one step, and the objective and the number of points under the model before it."""
    parts, logs, n = sums(points, model, vec)
    weights, means, covariances = [], [], []
    for (weight, offsets, products), mean in zip(parts, model.means):
        shift = offsets / weight if weight > 0 else np.zeros_like(mean)
        spread = products - weight * np.outer(shift, shift) + model.strength * model.spread * np.eye(len(mean))
        weights.append(weight / n if n else 0.0)
        means.append(mean + shift)
        covariances.append(spread / (weight + model.strength) if weight + model.strength > 0 else model.spread * np.eye(len(mean)))
    return Mixture(np.array(weights), np.array(means), np.array(covariances), model.spread, model.strength), logs + model.log_prior(), n


def fit(points: DataFrame, components: int, seed: int = 0, vec: str = "x", most: int = 100, tolerance: float = 1e-3, ridge: float = 1e-3, strength: float = 1.0) -> tuple[Mixture, list[float]]:
    """A mixture and the objective before each step, which ends when it grows by less than tolerance a point.

    It starts from k-means. The prior has the weight of strength points, with
    ridge times the variance within the clusters as their spread. Null
    vectors don't count; there must be a point.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.where(F.col(vec).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    start = KMeans(k=components, seed=seed, featuresCol="v", predictionCol="cluster").fit(data)
    means, sizes = np.array([c for c in start.clusterCenters()]), np.maximum(1, np.array(start.summary.clusterSizes, float))
    k, d = means.shape
    variance = max(start.summary.trainingCost / sizes.sum() / d, 1e-12)
    model, history = Mixture(sizes / sizes.sum(), means, np.tile(variance * np.eye(d), (k, 1, 1)), ridge * variance, strength), []
    for _ in range(most):
        after, objective, n = step(points, model, vec)
        history.append(objective)
        model = after
        if len(history) > 1 and history[-1] - history[-2] < tolerance * n:
            break
    return model, history


def assigned(df: DataFrame, model: Mixture, vec: str = "x", out_col: str = "cluster") -> DataFrame:
    """df with out_col: the component that has the largest share in the point; null for null vectors."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name != out_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(vec).to_pylist()
            there = [i for i, v in enumerate(x) if v is not None]
            found = [None] * len(x)
            if there:
                best = shipped.value.log_densities(np.array([x[i] for i in there], float)).argmax(1)
                for i, c in zip(there, best.tolist()):
                    found[i] = c
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.int32())], names=schema.names)

    return df.select(*(f.name for f in kept)).mapInArrow(run, schema)
