"""Networks over a batch of graphs packed as one: encoders, convolutions on a graph and its line graph, decoders.

Parameters are a dict from a dotted name to an array; a model is built by
asking for the names it needs, so that the same code makes and applies it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tape import Value, concat, gather, layer_norm, scatter, sigmoid, silu, softplus


@dataclass
class Batch:
    """Arrays of several graphs one after another; ends and pairs count over all of them."""

    species: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    dist: np.ndarray
    u: np.ndarray
    v: np.ndarray
    angle: np.ndarray
    dihedral: np.ndarray
    graph: dict[str, np.ndarray]
    vec: np.ndarray | None = None
    features: np.ndarray | None = None
    time: np.ndarray | None = None


class Params:
    """Named parameters, made on first use by the seeded generator if make is set."""

    def __init__(self, arrays: dict[str, np.ndarray] | None = None, seed: int = 0):
        self.make, self.draw = arrays is None, np.random.default_rng(seed)
        self.values = {k: Value(a) for k, a in (arrays or {}).items()}

    def get(self, name: str, shape: tuple[int, ...], start: str = "uniform") -> Value:
        if name not in self.values:
            if not self.make:
                raise KeyError(f"the model has no {name}")
            bound = 1 / np.sqrt(shape[0])
            self.values[name] = Value({"uniform": lambda: self.draw.uniform(-bound, bound, shape), "one": lambda: np.ones(shape), "zero": lambda: np.zeros(shape), "normal": lambda: self.draw.normal(0, 1, shape)}[start]())
        return self.values[name]

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: v.data for k, v in self.values.items()}


def linear(p: Params, name: str, x: Value, size: int) -> Value:
    return x @ p.get(f"{name}.w", (x.data.shape[1], size)) + p.get(f"{name}.b", (1, size), "zero")


def mlp(p: Params, name: str, x: Value, sizes: list[int], act=silu) -> Value:
    for i, n in enumerate(sizes):
        x = linear(p, f"{name}.{i}", x, n)
        x = act(x) if i + 1 < len(sizes) else x
    return x


def normed(p: Params, name: str, x: Value) -> Value:
    n = x.data.shape[1]
    return layer_norm(x, p.get(f"{name}.scale", (1, n), "one"), p.get(f"{name}.shift", (1, n), "zero"))


def bessel(x: np.ndarray, end: float, count: int, eps: float = 1e-5) -> np.ndarray:
    x = x[:, None] + eps
    return np.sqrt(2 / end) * np.sin(np.arange(1, count + 1) * np.pi * x / end) / x


def gaussian(x: np.ndarray, start: float, end: float, count: int) -> np.ndarray:
    centers = np.linspace(start, end, count)
    step = centers[1] - centers[0] if count > 1 else 1.0
    return np.exp(-(((x[:, None] - centers) / step) ** 2)) / 1.12


def encode_angles(b: Batch, dim: int) -> np.ndarray:
    """Without dihedrals the cosine over dim; with them half of dim for bond angles, a quarter each for cosine and sine of dihedrals."""
    if not b.dihedral.any():
        return gaussian(np.cos(b.angle), -1, 1, dim)
    out, half, quarter = np.zeros((len(b.angle), dim)), dim // 2, dim // 4
    d = b.dihedral
    out[~d, :half] = gaussian(np.cos(b.angle[~d]), -1, 1, half)
    out[d, half : half + quarter] = gaussian(np.cos(b.angle[d]), -1, 1, quarter)
    out[d, half + quarter : half + 2 * quarter] = gaussian(np.sin(b.angle[d]), -1, 1, quarter)
    return out


def encode_atomic(p: Params, b: Batch, species: int, dim: int, cutoff: float):
    atoms = normed(p, "enc.atom.norm", mlp(p, "enc.atom", Value(np.eye(species)[b.species]), [dim, dim]))
    bonds = normed(p, "enc.bond.norm", mlp(p, "enc.bond", Value(bessel(b.dist, cutoff, dim)), [dim, dim]))
    angles = normed(p, "enc.angle.norm", mlp(p, "enc.angle", Value(encode_angles(b, dim)), [dim, dim]))
    return atoms, bonds, angles


def encode_generic(p: Params, b: Batch, dim: int, cutoff: float, basis: str = "gaussian"):
    """Any features of nodes; distances and angles in a basis first."""
    wide = (lambda x, hi: gaussian(x, -hi, hi, dim)) if basis == "gaussian" else (lambda x, hi: bessel(np.abs(x), hi, dim))
    return (
        normed(p, "enc.atom.norm", mlp(p, "enc.atom", Value(b.features), [dim, dim])),
        normed(p, "enc.bond.norm", mlp(p, "enc.bond", Value(wide(b.dist, cutoff)), [dim, dim])),
        normed(p, "enc.angle.norm", mlp(p, "enc.angle", Value(wide(b.angle / np.pi, 1.0)), [dim, dim])),
    )


def initial_embedding(p: Params, b: Batch, species: int, dim: int, cutoff: float):
    """A learnt vector per species and a basis of the distance."""
    return gather(p.get("embed.species", (species, dim), "normal"), b.species), Value(bessel(b.dist, cutoff, dim))


def mesh_conv(p: Params, name: str, x: Value, e: Value, i: np.ndarray, j: np.ndarray):
    """Edges see both ends, nodes the sum of the edges that leave them; both keep what they had."""
    n, d = x.data.shape
    e = e + normed(p, f"{name}.edge.norm", mlp(p, f"{name}.edge", concat([gather(x, i), gather(x, j), e]), [d, d]))
    x = x + normed(p, f"{name}.node.norm", mlp(p, f"{name}.node", concat([x, scatter(e, i, n)]), [d, d]))
    return x, e


def gated_conv(p: Params, name: str, x: Value, e: Value, i: np.ndarray, j: np.ndarray, factored: bool = False, eps: float = 1e-5):
    """Messages from i to j, gated by their edge: the gate over the sum of the gates that leave i."""
    n, d = x.data.shape
    gate = sigmoid(e)
    share = gate / (gather(scatter(gate, i, n), i) + eps)
    message = scatter(share * gather(linear(p, f"{name}.source", x, d), i), j, n)
    new = x + silu(normed(p, f"{name}.node.norm", linear(p, f"{name}.self", x, d) + message))
    if factored:
        raw = gather(linear(p, f"{name}.edge_i", x, d), i) + gather(linear(p, f"{name}.edge_j", x, d), j) + linear(p, f"{name}.edge_e", e, d)
    else:
        raw = linear(p, f"{name}.edge", concat([gather(x, i), gather(x, j), e]), d)
    return new, e + silu(normed(p, f"{name}.edge.norm", raw))


CONVS = {"mesh": mesh_conv, "gated": gated_conv, "gated_v2": lambda *a: gated_conv(*a, factored=True)}


def process(p: Params, b: Batch, atoms: Value, bonds: Value, angles: Value, convs: int, conv: str = "mesh", on_angles: bool = True):
    """Layer by layer the line graph (bonds and angles), then the graph (atoms and bonds). A graph without angles goes through the same layers, so that its batch doesn't matter."""
    if conv not in CONVS:
        raise ValueError(f"no such convolution: {conv}")
    step = CONVS[conv]
    for k in range(convs):
        if on_angles:
            bonds, angles = step(p, f"proc.{k}.a", bonds, angles, b.u, b.v)
        atoms, bonds = step(p, f"proc.{k}.g", atoms, bonds, b.src, b.dst)
    return atoms, bonds, angles


def decode(p: Params, parts, dim: int, out_dim: int, positive: bool = False):
    """Contributions of atoms, bonds and angles: by one shared network, or by one each with positive results."""
    if positive:
        return [softplus(mlp(p, f"dec.{name}", x, [dim, out_dim])) for name, x in zip(("atom", "bond", "angle"), parts)]
    return [mlp(p, "dec", x, [dim, out_dim]) for x in parts]


def encode(p: Params, b: Batch, species: int, dim: int, cutoff: float, generic: bool = False, basis: str = "gaussian"):
    return encode_generic(p, b, dim, cutoff, basis) if generic else encode_atomic(p, b, species, dim, cutoff)


def line_graph_net(p: Params, b: Batch, species: int, dim: int, convs: int, cutoff: float, out_dim: int = 1, conv: str = "mesh", positive: bool = False, generic: bool = False, on_angles: bool = True, basis: str = "gaussian"):
    enc = encode(p, b, species, dim, cutoff, generic, basis)
    return decode(p, process(p, b, *enc, convs, conv, on_angles), dim, out_dim, positive)


def latent(p: Params, b: Batch, species: int, dim: int, convs: int, cutoff: float, conv: str = "mesh", generic: bool = False, on_angles: bool = True, basis: str = "gaussian"):
    return process(p, b, *encode(p, b, species, dim, cutoff, generic, basis), convs, conv, on_angles)


def mesh_graph_net(p: Params, b: Batch, species: int, dim: int, convs: int, out_dim: int = 3, time_dim: int = 0):
    """Edges from their vector and length, results for nodes only; with time_dim each graph's time joins its nodes."""
    nodes = mlp(p, "enc.node", Value(np.eye(species)[b.species]), [dim, dim])
    if time_dim:
        wave = 2 * np.pi * b.time[:, None] * p.get("enc.time.b", (1, time_dim // 2), "normal").data
        nodes = nodes + mlp(p, "enc.time", Value(np.concatenate([np.cos(wave), np.sin(wave)], 1)[b.graph["atom"]]), [dim, dim])
    edges = mlp(p, "enc.edge", Value(np.concatenate([b.vec, np.linalg.norm(b.vec, axis=1, keepdims=True)], 1)), [dim, dim])
    nodes, edges = normed(p, "enc.node.norm", nodes), normed(p, "enc.edge.norm", edges)
    for k in range(convs):
        nodes, edges = mesh_conv(p, f"proc.{k}", nodes, edges, b.src, b.dst)
    return mlp(p, "dec", nodes, [dim, out_dim])


def gated_net(p: Params, b: Batch, species: int, dim: int = 100, convs: int = 3, cutoff: float = 4.0, out_dim: int = 1):
    x, e = initial_embedding(p, b, species, dim, cutoff)
    for k in range(convs):
        x, e = gated_conv(p, f"conv.{k}", x, e, b.src, b.dst)
    return linear(p, "out", x, out_dim)


KINDS = ("atom", "bond", "angle")
#: The networks, by the name that settings give under "net", and the kinds of rows that they have results for.
NETS = {
    "line_graph": (lambda p, b, **s: line_graph_net(p, b, **s), KINDS),
    "mesh_graph": (lambda p, b, **s: [mesh_graph_net(p, b, **s)], KINDS[:1]),
    "gated": (lambda p, b, **s: [gated_net(p, b, **s)], KINDS[:1]),
}


def apply(p: Params, b: Batch, settings: dict) -> list[tuple[str, Value]]:
    """(kind, contributions) of the network that settings name: net, the size of generic features, and the network's own arguments."""
    name = settings.get("net", "line_graph")
    if name not in NETS:
        raise ValueError(f"no such network: {name}")
    net, kinds = NETS[name]
    return list(zip(kinds, net(p, b, **{k: v for k, v in settings.items() if k not in ("net", "features")})))
