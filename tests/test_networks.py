import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import graphs
from nodeloom.operators.nn import models, tape, train
from nodeloom.sources import tables


def batch(seed=0, dihedral=False):
    draw = np.random.default_rng(seed)
    n, m, t = 7, 16, 20
    graph = {"atom": np.repeat([0, 1], [4, 3]), "bond": np.repeat([0, 1], [9, 7]), "angle": np.repeat([0, 1], [12, 8])}
    return models.Batch(draw.integers(0, 3, n), draw.integers(0, n, m), draw.integers(0, n, m), draw.uniform(0.5, 3, m), draw.integers(0, m, t), draw.integers(0, m, t), draw.uniform(0, 3, t), draw.random(t) < 0.4 if dihedral else np.zeros(t, bool), graph, draw.normal(0, 1, (m, 3)), draw.normal(0, 1, (n, 5)), draw.random(2))


NETS = {
    "mesh": lambda p, b: models.line_graph_net(p, b, 3, 8, 2, 4.0, 2),
    "gated": lambda p, b: models.line_graph_net(p, b, 3, 8, 2, 4.0, conv="gated"),
    "gated_v2": lambda p, b: models.line_graph_net(p, b, 3, 8, 1, 4.0, conv="gated_v2", positive=True),
    "generic": lambda p, b: models.line_graph_net(p, b, 3, 8, 1, 4.0, generic=True),
    "mesh_graph_net": lambda p, b: [models.mesh_graph_net(p, b, 3, 8, 2)],
    "mesh_graph_net_time": lambda p, b: [models.mesh_graph_net(p, b, 3, 8, 1, time_dim=6)],
    "gated_net": lambda p, b: [models.gated_net(p, b, 3, 8, 2)],
}


@pytest.mark.parametrize("name", NETS)
@pytest.mark.parametrize("dihedral", [False, True])
def test_gradients_by_differences(name, dihedral):
    b, net = batch(1, dihedral), NETS[name]
    p = models.Params(seed=3)
    loss = lambda p: tape.total(tape.concat([x * x for x in net(p, b)], 0))
    loss(p)
    weights, draw = p.arrays(), np.random.default_rng(0)
    p = models.Params(weights)
    loss(p).backward()
    for k in draw.permutation(list(weights))[:12]:
        if p.values[k].grad is None:
            continue
        at = tuple(draw.integers(0, s) for s in weights[k].shape)
        moved = {s: models.Params(weights | {k: weights[k] + s * 1e-5 * (np.indices(weights[k].shape) == np.reshape(at, (-1, *[1] * weights[k].ndim))).all(0)}) for s in (1, -1)}
        slope = (loss(moved[1]).data - loss(moved[-1]).data) / 2e-5
        assert np.isclose(slope, p.values[k].grad[at], rtol=1e-4, atol=1e-6), k


def test_nodes_in_any_order():
    b = batch(2)
    p = models.Params(seed=1)
    one = models.line_graph_net(p, b, 3, 8, 2, 4.0)
    order = np.random.default_rng(5).permutation(7)
    back = np.argsort(order)
    moved = models.Batch(b.species[order], back[b.src], back[b.dst], b.dist, b.u, b.v, b.angle, b.dihedral, b.graph)
    two = models.line_graph_net(models.Params(p.arrays()), moved, 3, 8, 2, 4.0)
    assert np.allclose(one[0].data[order], two[0].data) and np.allclose(one[1].data, two[1].data)


def test_a_graph_without_angles_does_not_depend_on_its_batch():
    b = batch(6)
    p = models.Params(seed=1)
    models.line_graph_net(p, b, 3, 8, 2, 4.0)
    own = lambda k: b.graph[k] == 0
    none = np.zeros(0, int)
    few = models.Batch(b.species, b.src, b.dst, b.dist, none, none, np.zeros(0), np.zeros(0, bool), b.graph | {"angle": none})
    more = models.Batch(*(np.concatenate([getattr(few, c), getattr(b, c) + s]) for c, s in (("species", 0), ("src", 7), ("dst", 7), ("dist", 0), ("u", 16), ("v", 16), ("angle", 0))), np.concatenate([few.dihedral, b.dihedral]), {k: np.concatenate([few.graph[k], b.graph[k] + 2]) for k in b.graph})
    alone, together = (models.line_graph_net(models.Params(p.arrays()), x, 3, 8, 2, 4.0) for x in (few, more))
    assert np.allclose(alone[0].data, together[0].data[:7]) and np.allclose(alone[1].data, together[1].data[:16]) and own("atom").any()


def steps_of(name, rate, grads, start):
    w, step, out = {"w": np.array(start)}, train.Optimizer(name, rate), []
    for g in grads:
        w = step.step(w, {"w": np.array(g)})
        out.append(w["w"].copy())
    return np.array(out)


def test_optimizers_by_their_formulas():
    """Two or three steps written out by hand."""
    g = [[1.0, -2.0], [0.5, 0.0], [-1.0, 1.0]]
    start = [1.0, 1.0]
    # averaged descent: the weight shrinks, the rate falls
    got = steps_of("ASGD", 0.1, g, start)
    w, eta = np.array(start), 0.1
    for t, x in enumerate(g, 1):
        w = w * (1 - 1e-4 * eta) - eta * np.array(x)
        eta = 0.1 / (1 + 1e-4 * 0.1 * t) ** 0.75
        assert np.allclose(got[t - 1], w, atol=1e-12)
    # sparse moments: nothing happens where there is no gradient
    got = steps_of("SparseAdam", 0.1, g, start)
    assert got[1][1] == got[0][1] != got[2][1] and np.allclose(got[0], np.array(start) - 0.1 * np.sign(g[0]), atol=1e-6)
    m, v = 0.1 * 1.0, 0.001 * 1.0
    m, v = 0.9 * m + 0.1 * 0.5, 0.999 * v + 0.001 * 0.25
    assert np.isclose(got[1][0], got[0][0] - 0.1 * np.sqrt(1 - 0.999**2) / (1 - 0.9**2) * m / (np.sqrt(v) + 1e-8))
    # momentum that warms up
    got = steps_of("NAdam", 0.1, g[:1], start)
    mu1, mu2 = (0.9 * (1 - 0.5 * 0.96 ** (i * 0.004)) for i in (1, 2))
    x = np.array(g[0])
    root = np.sqrt(0.001 * x * x / (1 - 0.999)) + 1e-8
    assert np.allclose(got[0], np.array(start) - 0.1 * (1 - mu1) / (1 - mu1) * x / root - 0.1 * mu2 / (1 - mu1 * mu2) * 0.1 * x / root)
    with pytest.raises(ValueError, match="nope"):
        train.Optimizer("nope")


def test_lbfgs_solves_a_quadratic():
    a = np.diag([1.0, 10.0, 100.0])
    w, step = {"b": np.array([5.0, -3.0]), "c": np.array([[2.0]])}, train.Optimizer("LBFGS", 1.0)
    for _ in range(60):
        x = np.concatenate([w["b"], w["c"].ravel()])
        g = a @ x
        w = step.step(w, {"b": g[:2], "c": g[2:].reshape(1, 1)})
    assert np.abs(w["b"]).max() < 1e-6 and abs(w["c"][0, 0]) < 1e-6


@pytest.mark.parametrize("name", ["sparseadam", "sgd", "momentum", "adam", "adamw", "rmsprop", "adagrad", "adamax", "nadam", "radam", "adadelta", "asgd", "rprop", "lion"])
def test_optimizers_descend(name):
    w, step = {"w": np.array([3.0, -2.0])}, train.Optimizer(name, 1.0 if name in ("adadelta", "adagrad") else 0.05)
    for _ in range(400):
        w = step.step(w, {"w": 2 * w["w"]})
    assert np.abs(w["w"]).max() < (2.0 if name == "adadelta" else 0.6)
    assert step.step({"enc.w": np.ones(2)}, {"enc.w": np.ones(2)}, ("enc",))["enc.w"].tolist() == [1, 1]


def test_training_on_spark(spark, tmp_path):
    points, targets = tables.random_clouds(spark, 12, 5, 8, 3)
    pairs = points.alias("a").join(points.alias("b"), "gid").where("a.node_id <> b.node_id")
    dist = F.sqrt(F.aggregate(F.zip_with("a.x", "b.x", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    edges = graphs.with_edge_ids(pairs.select("gid", F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"), dist.alias("dist")).where("dist < 1.5"))
    angles = graphs.three_body_angles(edges, points)
    packed = train.pack({"nodes": points, "edges": edges, "angles": angles}, targets).cache()
    settings = {"species": 4, "dim": 8, "convs": 1, "cutoff": 2.0}
    weights, log = train.train(packed, packed, settings, epochs=6, rate=0.02)
    assert log[-1]["loss_train"] < log[0]["loss_train"]
    # One graph at a time gives what all together do.
    alone = {r.gid: r.pred[0] for r in train.predictions(packed.repartition(12), weights, settings).collect()}
    for r in train.predictions(packed.coalesce(1), weights, settings).collect():
        assert abs(alone[r.gid] - r.pred[0]) < 1e-9
    g1, lost, n = train.gradients(packed, weights, settings, rows=1)
    g2, _, _ = train.gradients(packed.coalesce(1), weights, settings)
    assert n == 12 and all(np.allclose(g1[k], g2[k]) for k in g1)
    tables.write_model(spark, weights, str(tmp_path / "m"), "one", {"losses": log})
    back = tables.read_model(spark, str(tmp_path / "m"))
    assert all(np.array_equal(back[k], weights[k]) for k in weights) and tables.read_model_info(spark, str(tmp_path / "m"))[0]["model_id"] == "one"
    assert train.latent_space(packed, weights, settings).count() == 12


def small_graphs(spark):
    points, targets = tables.random_clouds(spark, 10, 4, 7, 3)
    named = points.selectExpr("*", "x[0] AS px", "x[1] AS py", "x[2] AS pz")
    a, b = (named.select("gid", *(F.col(c).alias(f"{n}_{c}") for c in ("node_id", "px", "py", "pz"))) for n in "ab")
    pairs = a.join(b, "gid").where("a_node_id <> b_node_id")
    edges = pairs.selectExpr("gid", "a_node_id AS src", "b_node_id AS dst", "b_px - a_px AS dx", "b_py - a_py AS dy", "b_pz - a_pz AS dz").withColumn("dist", F.sqrt(F.expr("dx * dx + dy * dy + dz * dz")))
    edges = graphs.with_edge_ids(edges.where("dist < 1.5"))
    return points, edges, targets


@pytest.mark.parametrize("settings", [{"net": "mesh_graph", "species": 4, "dim": 6, "convs": 1, "out_dim": 1}, {"net": "mesh_graph", "species": 4, "dim": 6, "convs": 1, "out_dim": 1, "time_dim": 4}, {"net": "gated", "species": 4, "dim": 6, "convs": 1, "cutoff": 2.0}, {"species": 4, "dim": 6, "convs": 1, "cutoff": 2.0, "generic": True, "features": 3}, {"species": 4, "dim": 6, "convs": 1, "cutoff": 2.0, "positive": True, "conv": "gated_v2"}])
def test_every_network_trains_on_spark(spark, settings):
    points, edges, targets = small_graphs(spark)
    nodes = points.withColumn("features", F.col("x")) if settings.get("generic") else points
    times = targets.select("gid", F.rand(3).alias("time"))
    packed = train.pack({"nodes": nodes, "edges": edges, "angles": graphs.bond_angles(edges).fillna({"angle": 0.0})}, targets, times)
    weights, log = train.train(packed, None, settings, epochs=5, rate=0.003, loss="max_n_percent" if settings.get("net") == "gated" else "mse", share=0.5)
    assert min(x["loss_train"] for x in log[1:]) < log[0]["loss_train"] and log[0]["saved"]
    assert {r.kind for r in train.contributions(packed, weights, settings).select("kind").distinct().collect()} == set(models.NETS[settings.get("net", "line_graph")][1])
    with pytest.raises(ValueError):
        train.gradients(packed, weights, settings, loss="nope")
    with pytest.raises(ValueError):
        train.initial_weights({"net": "nope"})


def test_a_run_from_its_settings(spark, tmp_path):
    from nodeloom.plans import config, runner

    points, edges, targets = small_graphs(spark)
    packed = train.pack({"nodes": points, "edges": edges, "angles": graphs.bond_angles(edges).fillna({"angle": 0.0})}, targets).cache()
    run = config.Run(config.Sampling(split=0.15), config.Model(species=4, dim=6, convs=1, cutoff=2.0, interpretable=True), config.Training(epochs=3, pretrain_epochs=2, batch_size=4, learning_rate=0.01, tolerance=0.0), str(tmp_path / "m"), str(tmp_path / "d"))
    weights, log = runner.run_training(packed, run, "first")
    read = lambda p: spark.read.parquet(str(tmp_path / p))
    roles = {r.role: r["count"] for r in read("d/splits/first").groupBy("role").count().collect()}
    assert sum(roles.values()) == 10 and set(roles) == {"test", "pretrain", "training", "validation"}
    assert read("m/first/epochs").groupBy("run_id").count().count() == 2 and len(log) == 3
    assert read("d/results/first/predictions").count() == roles["test"] and {"kind", "dim", "ratio"} <= set(read("d/results/first/rankings").columns)
    saved = tables.read_model(spark, str(tmp_path / "m/first/training"))
    assert set(saved) == set(weights) and tables.read_model_info(spark, str(tmp_path / "m/first/training"))[0]["saved"]
    assert config.Run.from_json("\n".join(r.value for r in spark.read.text(str(tmp_path / "m/first/settings"), wholetext=True).collect())) == run
    packed.unpersist()


def test_dictionaries_and_loaders(spark, tmp_path):
    from nodeloom.operators import training_windows

    tables.write_dictionary(spark, {"a": np.arange(3), "b": {"c": [1.5, None]}}, str(tmp_path / "x"))
    assert tables.read_dictionary(spark, str(tmp_path / "x")) == {"a": [0, 1, 2], "b": {"c": [1.5, None]}}
    rows = spark.range(100).withColumnRenamed("id", "gid")
    both = training_windows.loader({"training": rows, "validation": rows}, 1, (5, 10, 50))
    assert both["training"].select("batch").distinct().count() == 10 and both["validation"].select("batch").distinct().count() == 2
    assert set(training_windows.loader({"validation": rows}, 2, (5, 10, 50))) == {"validation"}
    with pytest.raises(ValueError):
        training_windows.loader({}, 3, (1, 1, 1))


def test_training_reads_pieces_made_once(spark, monkeypatch):
    points, edges, targets = small_graphs(spark)
    packed = train.pack({"nodes": points, "edges": edges, "angles": graphs.bond_angles(edges).fillna({"angle": 0.0})}, targets).coalesce(1)
    settings = {"species": 4, "dim": 6, "convs": 1, "cutoff": 2.0}
    monkeypatch.setattr(train, "ENTRIES", 60)  # shipped with bundled() in its pieces
    weights = train.initial_weights(settings)
    pieces = train.bundled(packed)
    assert pieces.agg(F.sum("graphs")).first()[0] == 10
    (a, lost, n), (b, same, m) = (train.gradients(df, weights, settings) for df in (packed, pieces))
    assert n == m == 10 and np.isclose(lost, same) and all(np.allclose(a[k], b[k]) and a[k].any() for k in a if k.startswith("dec"))
    off, again, _ = train.gradients(pieces, weights, settings, slopes=False)
    assert np.isclose(lost, again) and not any(g.any() for g in off.values())
    read, found = [], train.gradients
    monkeypatch.setattr(train, "gradients", lambda df, *a, **k: (read.append(df.columns), found(df, *a, **k))[1])
    train.train(packed, packed, settings, epochs=2)
    assert read == [["graphs", "bundle"]] * 4  # before, every pass turned all arrays over again
    (batch,) = packed.limit(10).toArrow().combine_chunks().to_batches()
    cut = list(train.cut_up([batch], 4))
    assert sum(p.num_rows for p in cut) == 10 and all(1 <= p.num_rows <= 4 for p in cut)
    whole, alone = train.to_batch(batch), [train.to_batch(batch.slice(i, 1)) for i in range(10)]
    assert np.array_equal(whole.dist, np.concatenate([x.dist for x in alone])) and whole.src.max() >= len(alone[0].species)
