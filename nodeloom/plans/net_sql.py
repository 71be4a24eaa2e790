"""A small network of fixed weights, and SQL that says what it computes, written out column by column from the same weights."""

from __future__ import annotations

import numpy as np

from ..operators.nn import train


def fixed_weights(settings: dict) -> dict[str, np.ndarray]:
    """Weights that any engine can repeat: waves over their number, between -0.7 and 0.7; scales of norms lie around 1."""
    out = {}
    for n, (name, w) in enumerate(sorted(train.initial_weights(settings).items())):
        wave = np.round(0.7 * np.sin(1 + 7 * n + 3 * np.arange(w.size)), 3).reshape(w.shape)
        out[name] = wave + 1 if name.endswith(".scale") else wave
    return out


def number(x: float) -> str:
    return f"({float(x):.17e})"


class Sql:
    """Steps of a network as common table expressions, one after another; each gives its keys and columns y0, y1, .."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.steps = weights, []

    def add(self, keys: list[str], columns: list[str], source: str) -> str:
        name = f"t{len(self.steps)}"
        self.steps.append(f"{name} AS MATERIALIZED (SELECT {', '.join([*keys, *(f'{c} AS y{i}' for i, c in enumerate(columns))])} FROM {source})")
        return name

    def linear(self, name: str, columns: list[str]) -> list[str]:
        w, b = self.weights[f"{name}.w"], self.weights[f"{name}.b"][0]
        return [" + ".join([number(b[k]), *(f"{c} * {number(w[i][k])}" for i, c in enumerate(columns))]) for k in range(w.shape[1])]

    def mlp(self, name: str, keys: list[str], columns: list[str], source: str, layers: int = 2) -> tuple[str, list[str]]:
        for i in range(layers):
            source = self.add(keys, self.linear(f"{name}.{i}", columns), source)
            columns = [f"y{k}" for k in range(self.weights[f"{name}.{i}.b"].shape[1])]
            if i + 1 < layers:
                source = self.add(keys, [f"{c} / (1 + exp(-{c}))" for c in columns], source)
        return source, columns

    def norm(self, name: str, keys: list[str], columns: list[str], source: str) -> tuple[str, list[str]]:
        scale, shift, n = self.weights[f"{name}.scale"][0], self.weights[f"{name}.shift"][0], len(columns)
        mean = "(" + " + ".join(columns) + f") / {n}"
        centered = self.add(keys, [f"{c} - {mean}" for c in columns], source)
        spread = "(" + " + ".join(f"{c} * {c}" for c in columns) + f") / {n}"
        return self.add(keys, [f"{c} / sqrt({spread} + 1e-5) * {number(scale[i])} + {number(shift[i])}" for i, c in enumerate(columns)], centered), columns

    def normed_mlp(self, name: str, keys: list[str], columns: list[str], source: str) -> str:
        made, own = self.mlp(name, keys, columns, source)
        return self.norm(f"{name}.norm", keys, own, made)[0]

    def mesh_conv(self, name: str, nodes: str, edges: str, node: list[str], edge: list[str], i: str, j: str, dim: int) -> tuple[str, str]:
        """nodes (node.., y..), edges (edge.., y..); i and j are keys of edges that name the last key of nodes."""
        *group, last = node
        met = lambda side, end: " AND ".join([*(f"{side}.{g} = e.{g}" for g in group), f"{side}.{last} = e.{end}"])
        both = ", ".join([*(f"e.{k}" for k in edge), *(f"{s}.y{k} AS {s}{k}" for s in ("a", "b", "e") for k in range(dim))])
        joined = f"(SELECT {both} FROM {edges} e JOIN {nodes} a ON {met('a', i)} JOIN {nodes} b ON {met('b', j)})"
        change = self.normed_mlp(f"{name}.edge", edge, [f"{s}{k}" for s in ("a", "b", "e") for k in range(dim)], joined)
        same = " AND ".join(f"e.{k} = c.{k}" for k in edge)
        new_edges = self.add([f"e.{k}" for k in edge], [f"e.y{k} + c.y{k}" for k in range(dim)], f"{edges} e JOIN {change} c ON {same}")
        sums = f"(SELECT {', '.join([*group, f'{i} AS {last}', *(f'sum(y{k}) AS s{k}' for k in range(dim))])} FROM {new_edges} GROUP BY {', '.join([*group, i])})"
        on = " AND ".join(f"n.{k} = s.{k}" for k in node)
        seen = f"(SELECT {', '.join([*(f'n.{k}' for k in node), *(f'n.y{k} AS n{k}' for k in range(dim)), *(f'coalesce(s.s{k}, 0) AS s{k}' for k in range(dim))])} FROM {nodes} n LEFT JOIN {sums} s ON {on})"
        change = self.normed_mlp(f"{name}.node", node, [f"{s}{k}" for s in ("n", "s") for k in range(dim)], seen)
        on = " AND ".join(f"n.{k} = c.{k}" for k in node)
        return self.add([f"n.{k}" for k in node], [f"n.y{k} + c.y{k}" for k in range(dim)], f"{nodes} n JOIN {change} c ON {on}"), new_edges


def species_columns(species: int) -> list[str]:
    return [f"CASE WHEN species = {k} THEN 1e0 ELSE 0e0 END" for k in range(species)]


def bessel_columns(x: str, end: float, count: int) -> list[str]:
    return [f"sqrt(2 / {number(end)}) * sin({n} * pi() * ({x} + 1e-5) / {number(end)}) / ({x} + 1e-5)" for n in range(1, count + 1)]


def line_graph_tables(weights: dict[str, np.ndarray], settings: dict) -> tuple[Sql, str, str, str]:
    """(steps, atoms, bonds, angles) before the decoder, from atoms (gid, node_id, species), edges (gid, edge_id, src, dst, dist) and angles (gid, edge_u, edge_v, angle)."""
    sql, dim, cutoff = Sql(weights), settings["dim"], settings["cutoff"]
    node, edge, corner = ["gid", "node_id"], ["gid", "edge_id", "src", "dst"], ["gid", "edge_u", "edge_v"]
    step = 2 / (dim - 1)
    cosines = [f"exp(-(((cos(angle) - {number(-1 + k * step)}) / {number(step)}) ** 2)) / 1.12e0" for k in range(dim)]
    atoms = sql.normed_mlp("enc.atom", node, species_columns(settings["species"]), "species_atoms")
    bonds = sql.normed_mlp("enc.bond", edge, bessel_columns("dist", cutoff, dim), "edges")
    angles = sql.normed_mlp("enc.angle", corner, cosines, "angles")
    for k in range(settings["convs"]):
        plain, angles = sql.mesh_conv(f"proc.{k}.a", f"(SELECT gid, edge_id, {', '.join(f'y{i}' for i in range(dim))} FROM {bonds})", angles, ["gid", "edge_id"], corner, "edge_u", "edge_v", dim)
        bonds = sql.add(["p.gid", "p.edge_id", "src", "dst"], [f"p.y{i}" for i in range(dim)], f"{plain} p JOIN edges USING (gid, edge_id)")
        atoms, bonds = sql.mesh_conv(f"proc.{k}.g", atoms, bonds, node, edge, "src", "dst", dim)
    return sql, atoms, bonds, angles


def line_graph_sql(weights: dict[str, np.ndarray], settings: dict) -> tuple[str, str]:
    """(common table expressions, the name of the last): (gid, pred) of the network with one shared decoder and one output."""
    sql, atoms, bonds, angles = line_graph_tables(weights, settings)
    parts = [sql.mlp("dec", ["gid"], [f"y{k}" for k in range(settings["dim"])], t)[0] for t in (atoms, bonds, angles)]
    union = " UNION ALL ".join(f"SELECT gid, y0 FROM {t}" for t in parts)
    sql.steps.append(f"preds AS (SELECT gid, sum(y0) AS pred FROM ({union}) GROUP BY gid)")
    return ", ".join(sql.steps), "preds"


def latent_sql(weights: dict[str, np.ndarray], settings: dict) -> tuple[str, str]:
    """The same for (gid, dim, value): the mean of all rows of a graph before the decoder."""
    sql, *tables = line_graph_tables(weights, settings)
    union = " UNION ALL ".join(f"SELECT gid, {k} AS dim, y{k} AS x FROM {t}" for t in tables for k in range(settings["dim"]))
    sql.steps.append(f"means AS (SELECT gid, CAST(dim AS INTEGER) AS dim, avg(x) AS value FROM ({union}) GROUP BY ALL)")
    return ", ".join(sql.steps), "means"


def gated_sql(weights: dict[str, np.ndarray], settings: dict) -> tuple[str, str]:
    """(gid, pred) of the gated network: the sum of its results for atoms."""
    sql, dim = Sql(weights), settings["dim"]
    node, edge = ["gid", "node_id"], ["gid", "edge_id", "src", "dst"]
    table = weights["embed.species"]
    own = [f"CASE species {' '.join(f'WHEN {s} THEN {number(table[s][k])}' for s in range(settings['species']))} END" for k in range(dim)]
    nodes, edges = sql.add(node, own, "species_atoms"), sql.add(edge, bessel_columns("dist", settings["cutoff"], dim), "edges")
    columns = [f"y{k}" for k in range(dim)]
    for c in range(settings["convs"]):
        name = f"conv.{c}"
        gates = sql.add(edge, [f"1 / (1 + exp(-{x}))" for x in columns], edges)
        sums = f"(SELECT gid, src, {', '.join(f'sum(y{k}) AS s{k}' for k in range(dim))} FROM {gates} GROUP BY gid, src)"
        shares = sql.add(["g.gid", "g.edge_id", "g.src", "g.dst"], [f"g.y{k} / (s{k} + 1e-5)" for k in range(dim)], f"{gates} g JOIN {sums} s ON s.gid = g.gid AND s.src = g.src")
        source = sql.add(node, sql.linear(f"{name}.source", columns), nodes)
        message = f"(SELECT h.gid, h.dst AS node_id, {', '.join(f'sum(h.y{k} * x.y{k}) AS m{k}' for k in range(dim))} FROM {shares} h JOIN {source} x ON x.gid = h.gid AND x.node_id = h.src GROUP BY h.gid, h.dst)"
        self_ = sql.add(node, sql.linear(f"{name}.self", columns), nodes)
        raw = sql.add(["n.gid", "n.node_id"], [f"n.y{k} + coalesce(m{k}, 0)" for k in range(dim)], f"{self_} n LEFT JOIN {message} m ON m.gid = n.gid AND m.node_id = n.node_id")
        change = sql.norm(f"{name}.node.norm", node, columns, raw)[0]
        both = ", ".join([*(f"e.{k}" for k in edge), *(f"{s}.y{k} AS {s}{k}" for s in ("a", "b", "e") for k in range(dim))])
        joined = f"(SELECT {both} FROM {edges} e JOIN {nodes} a ON a.gid = e.gid AND a.node_id = e.src JOIN {nodes} b ON b.gid = e.gid AND b.node_id = e.dst)"
        turned = sql.norm(f"{name}.edge.norm", edge, columns, sql.add(edge, sql.linear(f"{name}.edge", [f"{s}{k}" for s in ("a", "b", "e") for k in range(dim)]), joined))[0]
        nodes = sql.add(["n.gid", "n.node_id"], [f"n.y{k} + c.y{k} / (1 + exp(-c.y{k}))" for k in range(dim)], f"{nodes} n JOIN {change} c ON c.gid = n.gid AND c.node_id = n.node_id")
        edges = sql.add(["e.gid", "e.edge_id", "e.src", "e.dst"], [f"e.y{k} + c.y{k} / (1 + exp(-c.y{k}))" for k in range(dim)], f"{edges} e JOIN {turned} c ON c.gid = e.gid AND c.edge_id = e.edge_id")
    out = sql.add(["gid"], sql.linear("out", columns), nodes)
    sql.steps.append(f"preds AS (SELECT gid, sum(y0) AS pred FROM {out} GROUP BY gid)")
    return ", ".join(sql.steps), "preds"


def mesh_sql(weights: dict[str, np.ndarray], settings: dict) -> tuple[str, str]:
    """(gid, dim, pred) of the mesh network without a time: the sums of its results for atoms. edges also have dx, dy, dz."""
    sql, dim = Sql(weights), settings["dim"]
    node, edge = ["gid", "node_id"], ["gid", "edge_id", "src", "dst"]
    made, own = sql.mlp("enc.node", node, species_columns(settings["species"]), "species_atoms")
    nodes = sql.norm("enc.node.norm", node, own, made)[0]
    made, own = sql.mlp("enc.edge", edge, ["dx", "dy", "dz", "sqrt(dx * dx + dy * dy + dz * dz)"], "edges")
    edges = sql.norm("enc.edge.norm", edge, own, made)[0]
    for k in range(settings["convs"]):
        nodes, edges = sql.mesh_conv(f"proc.{k}", nodes, edges, node, edge, "src", "dst", dim)
    out, own = sql.mlp("dec", ["gid"], [f"y{k}" for k in range(dim)], nodes)
    union = " UNION ALL ".join(f"SELECT gid, {k} AS dim, {c} AS x FROM {out}" for k, c in enumerate(own))
    sql.steps.append(f"preds AS (SELECT gid, CAST(dim AS INTEGER) AS dim, sum(x) AS pred FROM ({union}) GROUP BY ALL)")
    return ", ".join(sql.steps), "preds"
