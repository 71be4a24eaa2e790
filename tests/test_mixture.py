"""Gaussian mixtures against plain expectation-maximisation in numpy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import mixture
from nodeloom.plans import catalogue


def drawn(seed, n=600, d=3):
    rng = np.random.default_rng(seed)
    centers = np.array([[0.0] * d, [6.0] + [0.0] * (d - 1), [0.0, 7.0] + [0.0] * (d - 2)])
    shape = rng.normal(size=(3, d, d)) * 0.6 + np.eye(d)
    kind = rng.integers(0, 3, n)
    return kind, np.einsum("nij,nj->ni", shape[kind], rng.normal(size=(n, d))) + centers[kind]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)


def plain(x, weights, means, covariances, spread, strength):
    """One step, written out."""
    d = x.shape[1]
    p = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt((2 * np.pi) ** d * np.linalg.det(c)) for w, m, c in zip(weights, means, covariances)], 1)
    s = p / p.sum(1, keepdims=True)
    new = [(s[:, k : k + 1] * x).sum(0) / s[:, k].sum() for k in range(len(weights))]
    spreads = [((s[:, k, None] * (x - m)).T @ (x - m) + strength * spread * np.eye(d)) / (s[:, k].sum() + strength) for k, m in enumerate(new)]
    return s.mean(0), np.array(new), np.array(spreads), np.log(p.sum(1)).sum()


def test_step(spark):
    _, x = drawn(1)
    start = mixture.Mixture(np.array([0.2, 0.5, 0.3]), x[:3] * 1.0, np.tile(np.eye(3) * 2, (3, 1, 1)), 0.1, 2.0)
    after, objective, n = mixture.step(frame(spark, x), start)
    w, m, c, logs = plain(x, start.weights, start.means, start.covariances, 0.1, 2.0)
    assert n == len(x) and objective == pytest.approx(logs + start.log_prior())
    assert np.allclose(after.weights, w) and np.allclose(after.means, m) and np.allclose(after.covariances, c)


@pytest.mark.parametrize("d,n,strength", [(3, 600, 1.0), (3, 600, 1e-9), (24, 40, 1.0)])
def test_objective_never_falls(spark, d, n, strength):
    """Also where components have fewer points than dimensions; without a prior of weight it is the likelihood itself."""
    _, x = drawn(2, n, d)
    model, history = mixture.fit(frame(spark, x), 3, 4, most=12, tolerance=-1.0, strength=strength)
    assert len(history) == 12 and all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:])) and history[-1] > history[0]
    assert all(np.linalg.eigvalsh(c).min() > 0 for c in model.covariances)


def test_groups_are_found(spark):
    kind, x = drawn(7)
    points = frame(spark, x).unionByName(spark.createDataFrame([(-1, None)], "id long, x array<double>")).withColumn("cluster", F.lit("old"))
    model, _ = mixture.fit(points, 3, 1)
    got = {r.id: r.cluster for r in mixture.assigned(points, model).collect()}
    assert got.pop(-1) is None and len(got) == len(x)
    same = sum(max(np.bincount([got[i] for i in np.flatnonzero(kind == k)], minlength=3)) for k in range(3))
    assert same > 0.95 * len(x)
    assert mixture.assigned(points.limit(0), model).count() == 0


def test_principal_axes(spark):
    from nodeloom.operators import paths

    _, x = drawn(9, 300, 5)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    want = vectors[:, ::-1][:, :2]
    want = want * np.sign(want[np.abs(want).argmax(0), [0, 1]])
    got = {r.id: r.p for r in paths.project(frame(spark, x).withColumn("p", F.lit("old")), 2).collect()}
    assert np.allclose([got[i] for i in range(300)], z @ want)
    assert np.allclose(np.var(list(got.values()), axis=0), values[::-1][:2])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_at_every_size(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no tables")
    got = catalogue.QUERIES["sample_gaussian_mixture"](spark, path)
    total, sampled = got.agg(F.count("*"), F.sum(F.col("sampled").cast("int"))).first()
    assert total == spark.read.parquet(f"{path}/embeddings.parquet").count() and sampled == -(-total // 5)
