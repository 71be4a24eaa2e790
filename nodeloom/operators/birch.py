"""Clustering by features that add up: trees per partition, merged upwards, then a clustering of their leaves.

A clustering feature is the number of points, their sum and the sum of their
squares, kept as mean and spread, which doesn't lose digits; those of two
groups give that of both, which tells the radius of the union. A tree takes each point into the nearest leaf if its
radius stays within a threshold, or else opens another. Leaves of partitions
are taken up by further trees, some partitions at a time, until one is left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Partitions whose leaves meet in one task.
FAN_IN = 16


def united(n1, mean1, spread1, n2, mean2, spread2):
    """The features of two groups together."""
    n, off = n1 + n2, mean2 - mean1
    return n, mean1 + off * (n2 / n), spread1 + spread2 + off @ off * (n1 * n2 / n)


@dataclass
class Node:
    """Features of what lies below, a row for each child, or for each leaf where there are no children: n, means and spreads, the sums of squared distances from the mean."""

    n: np.ndarray
    means: np.ndarray
    spreads: np.ndarray
    children: list[Node] = field(default_factory=list)

    def nearest(self, x: np.ndarray) -> int:
        return int(((self.means - x) ** 2).sum(1).argmin())

    def at(self, i: int):
        return self.n[i], self.means[i], self.spreads[i]

    def total(self):
        n = self.n.sum()
        mean = self.n @ self.means / n
        return n, mean, self.spreads.sum() + self.n @ ((self.means - mean) ** 2).sum(1)

    def put(self, i: int, n, mean, spread) -> None:
        self.n[i], self.means[i], self.spreads[i] = n, mean, spread

    def append(self, n, mean, spread, child: Node | None = None) -> None:
        self.n, self.means, self.spreads = np.append(self.n, n), np.vstack([self.means, mean]), np.append(self.spreads, spread)
        if child is not None:
            self.children.append(child)

    def split(self) -> Node:
        """Takes what is nearer to one of the two means that lie farthest apart out into another node."""
        apart = ((self.means[:, None] - self.means[None]) ** 2).sum(2)
        a, b = divmod(int(apart.argmax()), len(apart))
        away = apart[b] < apart[a]
        away[a], away[b] = False, a != b
        if a == b:  # all at one place
            away[len(away) // 2 :] = True
        other = Node(self.n[away], self.means[away], self.spreads[away], [c for c, x in zip(self.children, away) if x])
        self.n, self.means, self.spreads, self.children = self.n[~away], self.means[~away], self.spreads[~away], [c for c, x in zip(self.children, away) if not x]
        return other


class Tree:
    """Leaves whose radius is within threshold, at most branching to a node. Should there be more than most leaves, the threshold grows and they are taken up anew."""

    def __init__(self, dims: int, threshold: float, branching: int, most: int):
        self.dims, self.threshold, self.branching, self.most = dims, threshold, branching, most
        self.root, self.size = self.empty(), 0

    def empty(self) -> Node:
        return Node(np.empty(0), np.empty((0, self.dims)), np.empty(0))

    def insert(self, n: float, x: np.ndarray, spread: float = 0.0) -> None:
        """Takes up n points of mean x."""
        path, node = [], self.root
        while node.children:
            i = node.nearest(x)
            path.append((node, i))
            node = node.children[i]
        if len(node.n):
            i = node.nearest(x)
            both = united(*node.at(i), n, x, spread)
            if both[2] <= self.threshold**2 * both[0]:
                node.put(i, *both)
                for parent, j in path:
                    parent.put(j, *united(*parent.at(j), n, x, spread))
                return
        node.append(n, x, spread)
        self.size += 1
        other = node.split() if len(node.n) > self.branching else None
        for parent, j in reversed(path):
            parent.put(j, *parent.children[j].total())
            if other is not None:
                parent.append(*other.total(), other)
                other = parent.split() if len(parent.n) > self.branching else None
        if other is not None:
            old, self.root = self.root, self.empty()
            for half in (old, other):
                self.root.append(*half.total(), half)
        if self.size > self.most:
            self.grow()

    def leaves(self):
        """(n, means, spreads) of all leaves."""
        waiting, out = [self.root], []
        while waiting:
            node = waiting.pop()
            waiting += node.children
            if not node.children:
                out.append((node.n, node.means, node.spreads))
        return tuple(map(np.concatenate, zip(*out)))

    def grow(self) -> None:
        rows = self.leaves()
        while self.size > self.most:
            some = rows[1][:: max(1, len(rows[1]) // 256)]
            gaps = ((some[:, None] - some[None]) ** 2).sum(2)
            np.fill_diagonal(gaps, np.inf)
            self.threshold = max(1.2 * self.threshold, float(np.sqrt(np.median(gaps.min(1)))) / 2, 1e-12)
            self.root, self.size, most, self.most = self.empty(), 0, self.most, len(rows[0]) + 1
            for row in zip(*rows):
                self.insert(*row)
            self.most, rows = most, self.leaves()


_SCHEMA = "n double, mean array<double>, spread double, threshold double, origin long"


def _table(tree: Tree, origin: int):
    import pyarrow as pa

    n, means, spreads = tree.leaves()
    return [pa.array(n), pa.array(list(means), pa.list_(pa.float64())), pa.array(spreads), pa.array(np.full(len(n), tree.threshold)), pa.array(np.full(len(n), origin, np.int64))]


def leaves(points: DataFrame, threshold: float = 0.5, branching: int = 50, most: int = 1000, vec: str = "x") -> DataFrame:
    """(n, mean, spread, sums, square, threshold): the leaves of all points, at most most of them, and the radius they keep to. spread: the sum of squared distances from the mean; sums and square: of the points and of their squares. Null vectors are no points."""
    names = [part.split()[0] for part in _SCHEMA.split(", ")]

    def grow(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tree = None
        for batch in batches:
            for x in batch.column("x").to_pylist():
                v = np.array(x, float)
                tree = tree or Tree(len(v), threshold, branching, most)
                tree.insert(1.0, v)
        if tree is not None:
            yield pa.RecordBatch.from_arrays(_table(tree, TaskContext.get().partitionId()), names=names)

    def merge(table):
        import pyarrow as pa

        n, means, spreads, limit, origin = (table.column(c).to_pylist() for c in names)
        tree = Tree(len(means[0]), max(limit), branching, most)
        for _, i in sorted(((o, *m, k), i) for i, (o, m, k) in enumerate(zip(origin, means, n))):
            tree.insert(n[i], np.array(means[i]), spreads[i])
        return pa.Table.from_arrays(_table(tree, min(origin) // FAN_IN), names=names)

    found = stored(points.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("x")).mapInArrow(grow, _SCHEMA), "leaves")
    origins = (found.agg(F.max("origin")).first()[0] or 0) + 1
    while origins > 1:
        found = stored(found.groupBy(F.floor(F.col("origin") / FAN_IN)).applyInArrow(merge, _SCHEMA), "leaves")
        origins = -(-origins // FAN_IN)
    squares = F.aggregate("mean", F.lit(0.0), lambda a, m: a + m * m)
    return found.select("n", "mean", "spread", F.transform("mean", lambda m: m * F.col("n")).alias("sums"), (F.col("spread") + F.col("n") * squares).alias("square"), "threshold")


def ward(n: np.ndarray, centers: np.ndarray, clusters: int) -> np.ndarray:
    """The cluster of every center, numbered by first appearance: always the two whose union adds least to the sum of squares are joined."""
    m, label = len(n), np.arange(len(n))
    weight = n.astype(float).copy()
    cost = ((centers[:, None] - centers[None]) ** 2).sum(2) * (weight[:, None] * weight[None] / (weight[:, None] + weight[None]))
    np.fill_diagonal(cost, np.inf)
    for _ in range(m - max(1, clusters)):
        i, j = divmod(int(cost.argmin()), m)
        i, j = min(i, j), max(i, j)
        wi, wj = weight[i], weight[j]
        joined = ((wi + weight) * cost[i] + (wj + weight) * cost[j] - weight * cost[i, j]) / (wi + wj + weight)
        joined[[i, j]] = np.inf
        joined[~np.isfinite(cost[i])] = np.inf
        cost[i], cost[:, i], cost[j], cost[:, j] = joined, joined, np.inf, np.inf
        weight[i] = wi + wj
        label[label == j] = i
    _, first, number = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[number]


def assigned(points: DataFrame, clusters: int | None, threshold: float = 0.5, branching: int = 50, most: int = 1000, vec: str = "x", out_col: str = "cluster") -> DataFrame:
    """points with out_col: the cluster of the nearest leaf. Leaves, in the order of their centers, are joined to clusters by ward(), or each is one without clusters. Null vectors have none."""
    rows = sorted((tuple(r.mean), r.n) for r in leaves(points, threshold, branching, most, vec).collect())  # most rows at most
    kept = [f for f in points.schema.fields if f.name != out_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.IntegerType())])
    centers, n = np.array([c for c, _ in rows], float), np.array([n for _, n in rows], float)
    label = np.arange(len(n)) if clusters is None or len(n) <= clusters else ward(n, centers, clusters)
    sent = points.sparkSession.sparkContext.broadcast((centers, label))

    def run(batches):
        import pyarrow as pa

        centers, label = sent.value
        squares = (centers**2).sum(1) if len(centers) else None
        for batch in batches:
            x = batch.column(vec).to_pylist()
            there = [i for i, v in enumerate(x) if v is not None]
            found = [None] * len(x)
            if there:
                nearest = (squares[None] - 2 * np.array([x[i] for i in there], float) @ centers.T).argmin(1)
                for i, c in zip(there, label[nearest].tolist()):
                    found[i] = c
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.int32())], names=schema.names)

    return points.select(*(f.name for f in kept)).mapInArrow(run, schema)
