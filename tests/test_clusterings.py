"""Trees of clustering features and spectral clusters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import birch, sampling, spectral


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(parts)


def drawn(seed, n=800, d=3, groups=4):
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, groups, n)
    return kind, rng.normal(size=(groups, d))[kind] * 20 + rng.normal(size=(n, d))


@pytest.mark.parametrize("threshold,branching,most", [(0.8, 50, 1000), (0.8, 3, 1000), (0.1, 5, 40), (0.0, 4, 10_000)])
def test_leaves(spark, monkeypatch, threshold, branching, most):
    monkeypatch.setattr(birch, "FAN_IN", 2)
    _, x = drawn(1)
    x[::4] = x[0]
    got = birch.leaves(frame(spark, x), threshold, branching, most).collect()
    assert len(got) <= most and sum(r.n for r in got) == len(x)
    assert np.allclose(sum(np.array(r.sums) for r in got), x.sum(0)) and sum(r.square for r in got) == pytest.approx((x**2).sum())
    limit = max(r.threshold for r in got)
    assert all(r.spread <= r.n * limit**2 + 1e-12 for r in got) and (limit == threshold or most == 40)
    if threshold == 0:
        assert len(got) == len(np.unique(x, axis=0))


def test_tree_of_points_in_order():
    tree = birch.Tree(2, 0.5, 3, 10_000)
    x = np.random.default_rng(2).uniform(0, 20, (500, 2))
    for v in x:
        tree.insert(1.0, v)
    waiting = [tree.root]
    while waiting:
        node = waiting.pop()
        assert len(node.n) <= 3 and (not node.children or len(node.children) == len(node.n))
        for i, c in enumerate(node.children):
            assert np.allclose(node.means[i] * node.n[i], c.n @ c.means) and node.n[i] == c.n.sum()
        waiting += node.children
    assert tree.leaves()[0].sum() == 500 and len(tree.leaves()[0]) == tree.size


def test_ward_joins_what_is_near():
    centers = np.array([[0.0], [10.0], [0.5], [10.4], [30.0]])
    assert birch.ward(np.array([5, 5, 1, 9, 1]), centers, 3).tolist() == [0, 1, 0, 1, 2]
    assert birch.ward(np.ones(5), centers, 1).tolist() == [0] * 5 and birch.ward(np.ones(5), centers, 9).tolist() == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("method,params", [("birch", {"threshold": 1.5}), ("spectral", {})])
def test_groups_are_found(spark, method, params):
    kind, x = drawn(5, 240)
    df = frame(spark, x).withColumn("cluster", F.lit("old"))
    got = sampling.by_model(df, method, 4, 0.25, 1, **params).collect()
    label = {r.id: r.cluster for r in got}
    assert len(label) == 240 and sum(r.sampled for r in got) == 60
    assert all(len({label[i] for i in np.flatnonzero(kind == k)}) == 1 for k in range(4)) and len(set(label.values())) == 4


def test_eigenvalues(spark):
    rng = np.random.default_rng(3)
    n = 40
    w = np.triu(rng.uniform(0.1, 1, (n, n)) * (rng.uniform(size=(n, n)) < 0.15), 1)
    w[np.arange(n - 1), np.arange(1, n)] = 0.3
    full = w + w.T
    edges = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))], "src long, dst long, weight double")
    values, found = spectral.eigenvectors(edges, 4)
    scale = 1 / np.sqrt(full.sum(1))
    m = full * scale[:, None] * scale[None]
    want, vectors = np.linalg.eigh(m)
    assert np.allclose(values, want[::-1][:4], atol=1e-6)
    v = np.array([[r[f"v{i}"] for i in range(4)] for r in found.orderBy("node").collect()])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-6) and np.allclose(m @ v, v * values, atol=1e-3)
    assert all(abs(abs(v[:, i] @ vectors[:, n - 1 - i]) - 1) < 1e-3 for i in range(4))


def test_two_rings(spark):
    angle = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    ring = np.stack([np.cos(angle), np.sin(angle)], 1)
    x = np.concatenate([ring, 3 * ring]) + np.random.default_rng(4).normal(0, 0.03, (240, 2))
    label = {r.id: r.cluster for r in spectral.clusters_of(frame(spark, x), 2, 8).collect()}
    assert len({label[i] for i in range(120)}) == 1 and len({label[i] for i in range(120, 240)}) == 1 and label[0] != label[200]


def test_blocks_send_each_other_what_their_edges_ask_for(spark):
    rng = np.random.default_rng(8)
    n, wide, blocks = 60, 3, 5
    w = np.triu(rng.uniform(0.1, 1, (n, n)) * (rng.uniform(size=(n, n)) < 0.1), 1)
    w[np.arange(n - 1), np.arange(1, n)] = 0.3
    w[0, 1:] = 0.2  # one node with an edge to all others
    full = w + w.T
    edges = spark.createDataFrame([(int(3 * a), int(3 * b), float(w[a, b])) for a, b in zip(*np.nonzero(w))], "src long, dst long, weight double")
    net = spectral.normalised(edges)
    table, names = spectral.blocks_of(net, net.where("own = 1").select(F.col("src").alias("node")), blocks)
    place = {r.node: (r.at, r.place) for r in names.collect()}
    v, u = rng.normal(size=(2, n, wide))
    held = {b: [i for _, i in sorted((place[3 * i][1], i) for i in range(n) if place[3 * i][0] == b)] for b in range(blocks)}
    state = spark.createDataFrame([(b, spectral.STATE, b, v[i].tobytes(), u[i].tobytes(), None) for b, i in held.items() if i], spectral.BLOCK)
    first = spectral.turned(table, state, blocks, wide, np.eye(wide))
    m = full / np.sqrt(full.sum(1)[:, None] * full.sum(1))
    rows = [r for r in spectral.times(table, spectral.times(table, first, blocks, wide, 0.5, 0.1, False), blocks, wide, 2.0, 0.1, True).collect()]
    one = 0.5 * (m @ v - 0.1 * v)
    want = 2.0 * (m @ one - 0.1 * one) - v
    own = {r["at"]: r for r in rows if r.kind == spectral.STATE}
    for b, i in held.items():
        assert not i or np.allclose(np.frombuffer(own[b].a).reshape(-1, wide), want[i]) and np.allclose(np.frombuffer(own[b].b).reshape(-1, wide), one[i])
    assert len(rows) <= blocks + blocks**2  # not a row for each edge
    values, found = spectral.eigenvectors(edges, 3, block_nodes=13)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:3], atol=1e-6) and found.count() == n
