"""Packing graphs into rows, applying a network to them, and training it.

A graph is one row of arrays, so it fits a worker; rows of a partition are
packed by the number of their atoms, bonds and angles and run as one batch. Training ships the
weights, sums gradients by weight inside Spark, and takes one step per batch
on the driver; what comes back is as large as the model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...storage import forget, stored
from . import models
from .models import KINDS
from .tape import Value, scatter, total

#: The arrays of a packed graph and their types. Vectors of bonds, features of nodes and a time are there if the tables have them.
ARRAYS = {"species": "array<int>", "src": "array<int>", "dst": "array<int>", "dist": "array<double>", "dx": "array<double>", "dy": "array<double>", "dz": "array<double>", "u": "array<int>", "v": "array<int>", "angle": "array<double>", "dihedral": "array<boolean>", "features": "array<array<double>>"}
LOSSES = ("mse", "mae", "huber", "max_n_percent")


def pack(graph: dict[str, DataFrame], targets: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """(gid, species, src, dst, dist, dx, dy, dz, u, v, angle, dihedral, features, y, time) from nodes (gid, node_id, species_idx or features), edges and angles, ids from 0 in every graph."""
    rows = lambda df, order, *cols: df.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("r"))
    found = {c: None for c in ARRAYS}
    has = [c for c in ("species_idx", "features") if c in graph["nodes"].columns]
    packed = rows(graph["nodes"], ["node_id"], *has).select("gid", *(F.col(f"r.{c}").alias({"species_idx": "species"}.get(c, c)) for c in has))
    found |= {{"species_idx": "species"}.get(c, c): True for c in has}
    edges, ends = graph["edges"], [c for c in ("src", "dst", "dist", "dx", "dy", "dz") if c in graph["edges"].columns]
    packed = packed.join(rows(edges, ["edge_id"], *ends).select("gid", *(F.col(f"r.{c}").alias(c) for c in ends)), "gid", "left")
    found |= {c: True for c in ends}
    if "angles" in graph:
        angles = rows(graph["angles"], ["edge_u", "edge_v", "is_dihedral"], "angle").select("gid", F.col("r.edge_u").alias("u"), F.col("r.edge_v").alias("v"), F.col("r.angle").alias("angle"), F.col("r.is_dihedral").alias("dihedral"))
        packed = packed.join(angles, "gid", "left")
        found |= {c: True for c in ("u", "v", "angle", "dihedral")}
    packed = packed.join(targets.select("gid", F.col("y").cast("array<double>").alias("y")), "gid", "left") if targets is not None else packed.withColumn("y", F.array().cast("array<double>"))
    packed = packed.join(times.select("gid", F.col("time").cast("double").alias("time")), "gid", "left") if times is not None else packed.withColumn("time", F.lit(0.0))
    arrays = (F.coalesce(F.col(c).cast(t) if found[c] else F.lit(None).cast(t), F.array().cast(t)).alias(c) for c, t in ARRAYS.items())
    return packed.select("gid", *arrays, "y", F.coalesce("time", F.lit(0.0)).alias("time"))


#: Atoms, bonds and angles that run as one batch, unless a graph alone has more.
ENTRIES = 20_000


def cut_up(batches, rows: int):
    """Arrow batches of packed graphs in pieces of at most so many rows and about ENTRIES atoms, bonds and angles."""
    for batch in batches:
        upto = np.cumsum(sum(_sizes(batch, c) for c in ("species", "features", "src", "u")))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + ENTRIES, "right"))), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _sizes(batch, c: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(int)


def _flat(batch, c: str, kind) -> np.ndarray:
    return batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind)


def to_batch(packed) -> models.Batch:
    """The graphs of an Arrow batch as one, array by array."""
    n, m, k = np.maximum(_sizes(packed, "species"), _sizes(packed, "features")), _sizes(packed, "src"), _sizes(packed, "u")
    of = lambda sizes: np.repeat(np.arange(packed.num_rows), sizes)
    before, edges_before = np.cumsum(n) - n, np.cumsum(m) - m
    ends = {c: _flat(packed, c, int) + np.repeat(shift, sizes) for c, shift, sizes in (("src", before, m), ("dst", before, m), ("u", edges_before, k), ("v", edges_before, k))}
    vec = [_flat(packed, c, float) for c in ("dx", "dy", "dz")]
    wide = packed.column("features").flatten()
    return models.Batch(
        _flat(packed, "species", int), ends["src"], ends["dst"], _flat(packed, "dist", float), ends["u"], ends["v"],
        _flat(packed, "angle", float), _flat(packed, "dihedral", bool), {"atom": of(n), "bond": of(m), "angle": of(k)},
        np.stack(vec, 1) if all(len(x) == m.sum() for x in vec) else None, wide.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(wide), -1) if len(wide) else None, packed.column("time").to_numpy(zero_copy_only=False).astype(float),
    )


def bundled(packed: DataFrame) -> DataFrame:
    """(graphs, bundle): pieces of packed graphs as they run, each in Arrow's format, so that later passes turn no array of theirs over again."""

    def run(batches):
        import pyarrow as pa

        for part in cut_up(batches, 10_000):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["graphs", "bundle"])

    return packed.mapInArrow(run, "graphs int, bundle binary")


def unbundled(batches):
    import pyarrow as pa

    for batch in batches:
        for bundle in batch.column("bundle"):
            yield from pa.ipc.open_stream(bundle.as_buffer())


def _vectors(x: np.ndarray):
    """The rows of a matrix as an Arrow array of lists."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).ravel()))


def initial_weights(settings: dict, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights of the network that settings describe: net ("line_graph", "mesh_graph" or "gated"), features (the number of generic ones), and the arguments of that network."""
    one = np.zeros(1, int)
    b = models.Batch(one, one, one, np.ones(1), one, one, np.ones(1), np.zeros(1, bool), {k: one for k in KINDS}, np.ones((1, 3)), np.ones((1, settings.get("features", 1))), np.ones(1))
    p = models.Params(seed=seed)
    models.apply(p, b, settings)
    return p.arrays()


def contributions(packed: DataFrame, weights: dict, settings: dict, rows: int = 10_000) -> DataFrame:
    """(gid, kind, local_id, value) of every row that the network has a result for: atoms, and for line graphs bonds and angles."""
    shipped = packed.sparkSession.sparkContext.broadcast(weights)  # as large as the model, whatever the input
    gid = packed.schema["gid"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for part in cut_up(batches, rows):
            b = to_batch(part)
            for kind, x in models.apply(models.Params(shipped.value), b, settings):
                graph = b.graph[kind]
                first = np.searchsorted(graph, graph)
                yield pa.RecordBatch.from_arrays([part.column("gid").take(pa.array(graph)), pa.array([kind] * len(graph), pa.string()), pa.array(np.arange(len(graph)) - first), _vectors(x.data)], names=["gid", "kind", "local_id", "value"])

    return packed.mapInArrow(run, f"gid {gid}, kind string, local_id long, value array<double>")


def latent_space(packed: DataFrame, weights: dict, settings: dict, rows: int = 10_000) -> DataFrame:
    """(gid, x): the mean of all rows of a graph before the decoder of a line graph's network."""
    shipped = packed.sparkSession.sparkContext.broadcast(weights)
    gid = packed.schema["gid"].dataType.simpleString()
    inner = {k: settings[k] for k in ("species", "dim", "convs", "cutoff", "conv", "generic", "on_angles", "basis") if k in settings}

    def run(batches):
        import pyarrow as pa

        for part in cut_up(batches, rows):
            b = to_batch(part)
            parts = models.latent(models.Params(shipped.value), b, **inner)
            index = np.concatenate([b.graph[k] for k in KINDS])
            data = np.concatenate([x.data for x in parts])
            sums, n = scatter(Value(data), index, part.num_rows).data, np.bincount(index, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("gid"), _vectors(sums / np.maximum(n, 1)[:, None])], names=["gid", "x"])

    return packed.mapInArrow(run, f"gid {gid}, x array<double>")


def loss_of(p: models.Params, b: models.Batch, y: np.ndarray, settings: dict, loss: str) -> Value:
    """The summed loss of a batch: graphs' predictions are the sums of their contributions."""
    pred = None
    for kind, x in models.apply(p, b, settings):
        s = scatter(x, b.graph[kind], len(y))
        pred = s if pred is None else pred + s
    diff = pred - y
    if loss == "mse":
        return total(diff * diff)
    size = Value(np.abs(diff.data), ((diff, lambda g: g * np.sign(diff.data)),))
    if loss == "mae":
        return total(size)
    inside = np.abs(diff.data) <= 1
    return total(diff * diff * (0.5 * inside) + (size - 0.5) * (~inside * 1.0))


def worst_graphs(packed: DataFrame, weights: dict, settings: dict, share: float) -> DataFrame:
    """The share of packed, the number rounded up, whose targets lie farthest above their predictions; of a batch, which a task ranks."""
    gap = F.aggregate(F.zip_with("y", "pred", lambda a, b: a - b), F.lit(0.0), lambda a, b: a + b)
    gaps = predictions(packed, weights, settings).select("gid", gap.alias("gap"))
    chosen = gaps.orderBy(F.col("gap").desc(), "gid").limit(int(np.ceil(share * packed.count())))
    return packed.join(chosen.select("gid"), "gid", "left_semi")


def gradients(packed: DataFrame, weights: dict, settings: dict, loss: str = "mse", rows: int = 10_000, share: float = 0.1, slopes: bool = True) -> tuple[dict[str, np.ndarray], float, int]:
    """(gradient by name, summed loss, graphs): sums over all rows, taken in Spark element by element; packed may be bundled() unless its graphs are to be ranked. slopes: whether gradients are wanted, otherwise they are 0. With the loss "max_n_percent" squared errors of the worst share count alone."""
    if loss not in LOSSES:
        raise ValueError(f"no such loss: {loss}")
    if loss == "max_n_percent":
        packed, loss = worst_graphs(packed, weights, settings, share), "mse"
    shipped = packed.sparkSession.sparkContext.broadcast(weights)

    whole = "bundle" in packed.columns

    def run(batches):
        import pyarrow as pa

        sums, lost, seen = {}, 0.0, 0
        for part in cut_up(unbundled(batches) if whole else batches, rows):
            p = models.Params(shipped.value)
            out = loss_of(p, to_batch(part), _flat(part, "y", float).reshape(part.num_rows, -1), settings, loss)
            if slopes:
                out.backward()
            lost, seen = lost + float(out.data), seen + part.num_rows
            for k, v in p.values.items():
                if v.grad is not None:
                    sums[k] = sums.get(k, 0) + v.grad
        if seen:
            flat = [(k, g.ravel()) for k, g in sums.items()] + [("", np.array([lost, seen]))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in flat]), pa.array([v for _, v in flat], pa.list_(pa.float64()))], names=["name", "values"])

    parts = packed.mapInArrow(run, "name string, values array<double>")
    rows_ = parts.select("name", F.posexplode("values").alias("i", "g")).groupBy("name", "i").agg(F.sum("g").alias("g")).collect()
    found: dict[str, np.ndarray] = {"": np.zeros(2)} | {k: np.zeros(w.size) for k, w in weights.items()}
    for r in rows_:
        found[r["name"]][r["i"]] = r["g"]
    shipped.destroy()
    lost, seen = found.pop("")
    return {k: g.reshape(weights[k].shape) for k, g in found.items()}, float(lost), int(seen)


class Optimizer:
    """One step per call, with state that lasts. Rules by their published formulas, with the constants that are common for them."""

    NAMES = ("sgd", "momentum", "asgd", "adam", "adamw", "sparseadam", "adamax", "nadam", "radam", "adagrad", "adadelta", "rmsprop", "rprop", "lion", "lbfgs")

    def __init__(self, name: str = "adam", rate: float = 1e-3, decay: float = 0.0):
        if name.lower() not in self.NAMES:
            raise ValueError(f"no such optimizer: {name}")
        self.name, self.rate, self.decay, self.t, self.state = name.lower(), rate, decay, 0, {}

    def step(self, weights: dict, grads: dict, frozen: tuple[str, ...] = ()) -> dict:
        self.t += 1
        moved = {k: w for k, w in weights.items() if not k.startswith(frozen or ("\0",))}
        changes = self.joint(moved, grads) if self.name == "lbfgs" else {k: self.change(k, w, grads[k]) for k, w in moved.items()}
        return {k: w - changes[k] if k in changes else w for k, w in weights.items()}

    def joint(self, weights: dict, grads: dict, history: int = 100) -> dict:
        """Limited-memory BFGS on all weights at once, one evaluation a step: the two-loop recursion over the last steps and changes of the gradient."""
        flat = lambda d: np.concatenate([np.ravel(d[k]) for k in weights]) if weights else np.zeros(0)
        g, s = flat(grads) + self.decay * flat(weights), self.state.setdefault("", {"pairs": []})
        if "g" in s:
            y = g - s["g"]
            if y @ s["step"] > 1e-10:
                s["pairs"] = [*s["pairs"], (s["step"], y)][-history:]
        q, used = g.copy(), []
        for d, y in reversed(s["pairs"]):
            a = (d @ q) / (d @ y)
            q, used = q - a * y, [*used, a]
        if s["pairs"]:
            d, y = s["pairs"][-1]
            q = q * (d @ y) / (y @ y)
        for (d, y), a in zip(s["pairs"], reversed(used)):
            q = q + d * (a - (y @ q) / (d @ y))
        length = self.rate * (min(1.0, 1 / max(np.abs(g).sum(), 1e-30)) if self.t == 1 else 1.0)
        s["g"], s["step"] = g, -length * q
        out, at = {}, 0
        for k, w in weights.items():
            out[k], at = (length * q[at : at + w.size]).reshape(w.shape), at + w.size
        return out

    def change(self, k: str, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        s, r, t, eps = self.state.setdefault(k, {"m": np.zeros_like(w), "v": np.zeros_like(w)}), self.rate, self.t, 1e-8
        if self.decay and self.name != "adamw":
            g = g + self.decay * w
        if self.name == "sgd":
            return r * g
        if self.name == "asgd":  # a rate that falls, and from step t0 on the mean of the weights, kept in "mean"
            fall, power, t0 = 1e-4, 0.75, 1e6
            eta = r / (1 + fall * r * (t - 1)) ** power
            new = w * (1 - fall * eta) - eta * g
            share = 1 / max(1.0, t - 1 - t0)
            s["mean"] = new if share == 1 else s["mean"] + share * (new - s["mean"])
            return w - new
        if self.name == "momentum":
            s["m"] = 0.9 * s["m"] + g
            return r * s["m"]
        if self.name == "lion":
            step = np.sign(0.9 * s["m"] + 0.1 * g)
            s["m"] = 0.99 * s["m"] + 0.01 * g
            return r * step
        if self.name == "adagrad":
            s["v"] = s["v"] + g * g
            return r * g / (np.sqrt(s["v"]) + 1e-10)
        if self.name == "rmsprop":
            s["v"] = 0.99 * s["v"] + 0.01 * g * g
            return r * g / (np.sqrt(s["v"]) + eps)
        if self.name == "adadelta":
            s["v"] = 0.9 * s["v"] + 0.1 * g * g
            step = np.sqrt(s["m"] + 1e-6) / np.sqrt(s["v"] + 1e-6) * g
            s["m"] = 0.9 * s["m"] + 0.1 * step * step
            return r * step
        if self.name == "rprop":
            size = s.get("size", np.full_like(w, r))
            s["size"] = np.clip(size * np.where(g * s["m"] > 0, 1.2, np.where(g * s["m"] < 0, 0.5, 1.0)), 1e-6, 50)
            s["m"] = np.where(g * s["m"] < 0, 0, g)
            return np.sign(s["m"]) * s["size"]
        if self.name == "sparseadam":  # what has no gradient keeps its state
            there = g != 0
            s["m"] = np.where(there, 0.9 * s["m"] + 0.1 * g, s["m"])
            s["v"] = np.where(there, 0.999 * s["v"] + 0.001 * g * g, s["v"])
            return np.where(there, r * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * s["m"] / (np.sqrt(s["v"]) + eps), 0.0)
        s["m"] = 0.9 * s["m"] + 0.1 * g
        if self.name == "adamax":
            s["v"] = np.maximum(0.999 * s["v"], np.abs(g) + eps)
            return r / (1 - 0.9**t) * s["m"] / s["v"]
        s["v"] = 0.999 * s["v"] + 0.001 * g * g
        m, root = s["m"] / (1 - 0.9**t), np.sqrt(s["v"] / (1 - 0.999**t)) + eps
        if self.name == "nadam":  # momentum that warms up
            now, then = (0.9 * (1 - 0.5 * 0.96 ** (i * 4e-3)) for i in (t, t + 1))
            s["product"] = s.get("product", 1.0) * now
            return r * ((1 - now) / (1 - s["product"]) * g + then / (1 - s["product"] * then) * s["m"]) / root
        if self.name == "radam":
            most = 2 / (1 - 0.999) - 1
            long = most - 2 * t * 0.999**t / (1 - 0.999**t)
            if long <= 5:
                return r * m
            return r * m * np.sqrt((long - 4) * (long - 2) * most / ((most - 4) * (most - 2) * long)) * np.sqrt(1 - 0.999**t) / (np.sqrt(s["v"]) + eps)
        step = r * m / root
        return step + r * self.decay * w if self.name == "adamw" else step


def train(
    packed: DataFrame, valid: DataFrame | None, settings: dict, epochs: int = 10, batches: int = 1, optimizer: str = "adam", rate: float = 1e-2, loss: str = "mse", most: int = 4, tolerance: float = 0.0,
    seed: int = 0, frozen: tuple[str, ...] = (), weights: dict | None = None, reshuffle: int = 10, schedule=None, share: float = 0.1, most_loss: float = np.inf, save=None,
) -> tuple[dict, list[dict]]:
    """(best weights, a record per epoch).

    It stops once the mean change of the validation loss over the last most
    epochs is within tolerance and their mean within most_loss; batches are
    dealt anew every reshuffle epochs. valid None, as for a first training,
    or without rows: the training loss stands for both. save(weights, record), if given, is
    called in every epoch that is the best so far. share: of the worst graphs,
    for the loss "max_n_percent".
    """
    import time

    weights = weights or initial_weights(settings, seed)
    step, best, log = Optimizer(optimizer, rate), (np.inf, np.inf, weights), []
    kept = []
    # Read in every epoch: where all graphs count each time, as the pieces that they run in.
    for df in (packed, valid):
        ready = df is not None and loss != "max_n_percent" and (batches == 1 or df is valid)
        kept.append(df if df is None else stored(bundled(df), "graphs") if ready else df.cache())
    packed, valid = kept
    try:
        for epoch in range(epochs):
            began, lost, seen = time.time(), 0.0, 0
            step.rate = schedule(epoch) if schedule else rate
            for b in range(batches):
                part = packed if batches == 1 else packed.where(F.pmod(F.xxhash64(F.lit(seed + epoch // reshuffle), "gid"), F.lit(batches)) == b)
                g, part_lost, n = gradients(part, weights, settings, loss, share=share)
                if n:
                    weights = step.step(weights, {k: v / n for k, v in g.items()}, frozen)
                lost, seen = lost + part_lost, seen + n
            record = {"epoch": epoch, "loss_train": lost / max(seen, 1), "loss_valid": lost / max(seen, 1)}
            if valid is not None:
                _, valid_lost, valid_n = gradients(valid, weights, settings, loss, share=share, slopes=False)
                record["loss_valid"] = valid_lost / valid_n if valid_n else record["loss_train"]
            record |= {"seconds": time.time() - began, "saved": False}
            log.append(record)
            if record["loss_train"] < best[0]:
                record["saved"] = record["loss_valid"] < best[1]
                best = (record["loss_train"], *((record["loss_valid"], weights) if record["saved"] else best[1:]))
                if record["saved"] and save is not None:
                    save(weights, record)
            last = [x["loss_valid"] for x in log[-most:]]
            change = [abs(a["loss_valid"] - b["loss_valid"]) for a, b in zip(log, log[1:])][-most:]
            if len(change) >= most and sum(change) / most <= tolerance and sum(last) / most <= most_loss:
                break
    finally:
        for df in kept:
            if df is not None:
                forget(df) if "bundle" in df.columns else df.unpersist()
    return best[2], log


def predictions(packed: DataFrame, weights: dict, settings: dict) -> DataFrame:
    """(gid, pred, y, loss): the sums of contributions, and the mean squared error where there is a target."""
    sums = contributions(packed, weights, settings).select("gid", F.posexplode("value").alias("dim", "x")).groupBy("gid", "dim").agg(F.sum("x").alias("p"))
    pred = sums.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "p"))), lambda s: s["p"]).alias("pred"))
    square = F.aggregate(F.zip_with("pred", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return pred.join(packed.select("gid", "y"), "gid").withColumn("loss", F.when(F.size("y") > 0, square / F.size("pred")))
