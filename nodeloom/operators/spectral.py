"""Spectral clustering: leading eigenvectors of a graph's normalised edges by joins.

Nodes lie in blocks, and a few vectors over them in a table, a row per block.
The edges multiply them: each block is sent the values of the nodes that its
edges come from, packed, and sums them up. Between multiplications only
matrices as small as the vectors are few reach the driver. A Chebyshev
polynomial of the edges damps what is not wanted, so that a few rounds are
enough.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, stored
from .neighbors import knn


def normalised(edges: DataFrame) -> DataFrame:
    """(src, dst, w, own) from (src, dst, weight): symmetric, each weight over the roots of the sums at both ends, the larger of two that name the same edge; and a row for each node with itself, own, of weight 0."""
    both = edges.where("src <> dst").select("src", "dst", "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("weight > 0")
    degree = cut(both.groupBy("src").agg(F.sum("weight").alias("d")))
    met = both.join(degree, "src").join(degree.toDF("dst", "e"), "dst")
    return met.select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("w"), F.lit(0.0).alias("own")).unionByName(degree.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.lit(1.0).alias("own")))


#: Nodes of a block, on average.
BLOCK_NODES = 50_000
BLOCK = "at int, kind int, other int, a binary, b binary, c binary"
LIST, ENTRIES, STATE, SENT = range(4)  # kinds of rows of a block: what it sends to another, its edges from another, its vectors, what another sent


def blocks_of(net: DataFrame, nodes: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(table, names): the net of normalised() cut into blocks of nodes, and (node, at, place) where a node lies.

    A row of table (at, kind, other, a, b, c) is a LIST of the places in block
    at that block other asks for, or the ENTRIES of edges into block other:
    their places at the near end, their number in that list, and their weights.
    """
    import pyarrow as pa

    found = nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("at"))
    names = cut(found.withColumn("place", (F.row_number().over(Window.partitionBy("at").orderBy("node")) - 1).cast("int")))
    far = names.select(F.col("node").alias("dst"), F.col("at").alias("other"), F.col("place").alias("far"))
    edges = net.where("own = 0").join(names.withColumnRenamed("node", "src"), "src").join(far, "dst").select("at", "other", "place", "far", "w")

    def packed(key, table):
        place, far, w = (table.column(c).to_numpy() for c in ("place", "far", "w"))
        asked, which = np.unique(far, return_inverse=True)
        order = np.lexsort((which, place))
        at, other = (v.as_py() for v in key)
        rows = [(other, LIST, at, asked.astype(np.int32), None, None), (at, ENTRIES, other, place[order].astype(np.int32), which[order].astype(np.int32), w[order])]
        binary = lambda i: pa.array([None if r[i] is None else r[i].tobytes() for r in rows], pa.binary())
        return pa.table([*(pa.array([r[i] for r in rows], pa.int32()) for i in range(3)), *(binary(i) for i in (3, 4, 5))], names=["at", "kind", "other", "a", "b", "c"])

    return stored(edges.groupBy("at", "other").applyInArrow(packed, BLOCK), "blocks"), names


def times(table: DataFrame, state: DataFrame, blocks: int, wide: int, scale: float, shift: float, before: bool, more: bool = True) -> DataFrame:
    """From the rows STATE and SENT of vectors v and u those of: scale * (edges - shift) times v, less u if before; u becomes v. more: with what the next multiplication wants sent."""
    met = table.where(F.col("kind").isin(LIST, ENTRIES) if more else F.col("kind") == ENTRIES).unionByName(state).repartitionById(blocks, "at").sortWithinPartitions("at", "kind", "other")

    def run(batches):
        at, lists, entries, own, sums = None, [], {}, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] != at:
                    yield from told(at, lists, own, sums)
                    at, lists, entries, own, sums = r["at"], [], {}, None, None
                if r["kind"] == LIST:
                    lists.append((r["other"], np.frombuffer(r["a"], np.int32)))
                elif r["kind"] == ENTRIES:
                    entries[r["other"]] = np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.int32), np.frombuffer(r["c"])
                elif r["kind"] == STATE:
                    own = np.frombuffer(r["a"]).reshape(-1, wide)
                    sums = -scale * shift * own
                    if before:
                        sums = sums - np.frombuffer(r["b"]).reshape(-1, wide)
                else:
                    place, which, w = entries.pop(r["other"])
                    sent = np.frombuffer(r["a"]).reshape(-1, wide)
                    edge = np.flatnonzero(np.diff(place, prepend=-1))
                    for i in range(wide):
                        sums[place[edge], i] += scale * np.add.reduceat(w * sent[which, i], edge)
        yield from told(at, lists, own, sums)

    def told(at, lists, own, sums):
        if own is not None:
            yield _row(at, STATE, at, sums, own)
            for other, places in lists:
                yield _row(other, SENT, at, sums[places])

    return met.mapInArrow(run, BLOCK)


def _row(at: int, kind: int, other: int, a: np.ndarray, b: np.ndarray | None = None):
    import pyarrow as pa

    whole = lambda x: pa.array([None if x is None else np.ascontiguousarray(x).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (at, kind, other)), whole(a), whole(b), pa.array([None], pa.binary())], names=["at", "kind", "other", "a", "b", "c"])


def turned(table: DataFrame, state: DataFrame, blocks: int, wide: int, m: np.ndarray, column: str = "a") -> DataFrame:
    """The rows STATE and SENT of the vectors in a column of state, times a matrix."""
    met = table.where(F.col("kind") == LIST).unionByName(state.where(F.col("kind") == STATE)).repartitionById(blocks, "at").sortWithinPartitions("at", "kind", "other")

    def run(batches):
        at, lists = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] != at:
                    at, lists = r["at"], []
                if r["kind"] == LIST:
                    lists.append((r["other"], np.frombuffer(r["a"], np.int32)))
                else:
                    v = np.frombuffer(r[column]).reshape(-1, wide) @ m
                    yield _row(at, STATE, at, v)
                    for other, places in lists:
                        yield _row(other, SENT, at, v[places])

    return met.mapInArrow(run, BLOCK)


def products(state: DataFrame, wide: int, left: str, right: str) -> np.ndarray:
    """The sum over nodes of the products of two columns of vectors: a matrix as small as the block is wide."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                m = np.frombuffer(r[left]).reshape(-1, wide).T @ np.frombuffer(r[right]).reshape(-1, wide)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide * wide, dtype=np.int32)), pa.array(m.ravel())], names=["i", "x"])

    out = np.zeros(wide * wide)
    for r in state.where(F.col("kind") == STATE).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(wide, wide)


def eigenvectors(edges: DataFrame, wanted: int, extra: int = 6, degree: int = 8, rounds: int = 40, tolerance: float = 1e-8, block_nodes: int = BLOCK_NODES) -> tuple[np.ndarray, DataFrame]:
    """The wanted largest eigenvalues of the normalised edges (src, dst, weight), and (node, v0, v1, ..) their eigenvectors, in that order.

    It ends when none of the eigenvalues moves by more than tolerance. Values
    of the normalised Laplacian are 1 less these. Nodes lie in blocks of about
    block_nodes, or fewer where that leaves cores idle; a multiplication sends
    each block the vectors of the nodes that its edges come from.
    """
    import pyarrow as pa

    net = cut(normalised(edges))
    nodes = net.where("own = 1").select(F.col("src").alias("node"))
    n = nodes.count()
    wide = max(1, min(wanted + extra, n))
    blocks = max(1, -(-n // block_nodes), min(n // 2000, edges.sparkSession.sparkContext.defaultParallelism))
    table, names = blocks_of(net, nodes, blocks)
    start = names.select("at", "place", *((F.xxhash64("node", F.lit(i)) / F.lit(2.0**63)).alias(f"v{i}") for i in range(wide)))

    def gathered(key, table):
        t, at = table.sort_by("place"), key[0].as_py()
        return pa.Table.from_batches([_row(at, STATE, at, np.stack([t.column(f"v{i}").to_numpy() for i in range(wide)], 1))])

    block, values = cut(start.groupBy("at").applyInArrow(gathered, BLOCK)), None

    def spread(state: DataFrame, m: np.ndarray) -> DataFrame:
        """(node, v0, ..): the first vectors in column b times a matrix."""

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    v = np.frombuffer(r["b"]).reshape(-1, wide) @ m
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), r["at"], np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), *(pa.array(np.ascontiguousarray(v[:, i])) for i in range(m.shape[1]))], names=["at", "place", *(f"v{i}" for i in range(m.shape[1]))])

        rows = state.where(F.col("kind") == STATE).mapInArrow(run, ", ".join(["at int", "place int", *(f"v{i} double" for i in range(m.shape[1]))]))
        return names.join(rows, ["at", "place"]).drop("at", "place")

    for _ in range(rounds):
        # An orthonormal block, turned to the eigenvectors of the edges within it.
        size, turn = np.linalg.eigh(products(block, wide, "a", "a"))
        whole = turn / np.sqrt(np.maximum(size, 1e-14 * size.max()))
        state = cut(times(table, turned(table, block, blocks, wide, whole), blocks, wide, 1.0, 0.0, False, False))  # a: edges times the block, b: the block
        inner = products(state, wide, "b", "a")
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        found, turn = found[::-1], turn[:, ::-1]
        moved = np.inf if values is None else np.abs(found[:wanted] - values[:wanted]).max()
        values = found
        if moved <= tolerance or wide == 1 and moved < np.inf:
            break
        low, high = -1.0, min(float(values[-1]), 0.999)
        center, half = (low + high) / 2, max((high - low) / 2, 1e-3)
        block = times(table, turned(table, state, blocks, wide, turn, "b"), blocks, wide, 1 / half, center, False)
        for i in range(degree - 1):
            block = times(table, block, blocks, wide, 2 / half, center, True, i + 2 < degree)
        block = cut(block)
    return values[:wanted], spread(state, turn[:, :wanted])


def clusters_of(points: DataFrame, clusters: int, neighbors: int = 10, seed: int = 0, id_col: str = "id", vec: str = "x") -> DataFrame:
    """(id, cluster): k-means over the rows, of length 1, of the leading eigenvectors of the graph of nearest neighbors, weighed by a Gaussian of the mean squared distance. Points with a null vector are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    near = cut(knn(points.select(F.col(id_col).alias("node_id"), F.col(vec).alias("x")), neighbors))
    scale = near.agg(F.avg(F.col("dist") * F.col("dist"))).first()[0] or 1.0
    values, found = eigenvectors(near.select("src", "dst", F.exp(-F.col("dist") * F.col("dist") / F.lit(scale)).alias("weight")), clusters, rounds=15, tolerance=1e-6)
    rows = F.array(*(F.col(f"v{i}") for i in range(len(values))))
    length = F.sqrt(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x * x))
    data = found.select("node", array_to_vector(F.transform(rows, lambda x: x / F.greatest(length, F.lit(1e-300)))).alias("v"))
    models = [KMeans(k=clusters, seed=seed + i, featuresCol="v", predictionCol="cluster").fit(data) for i in range(3)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select(F.col("node").alias(id_col), "cluster")
