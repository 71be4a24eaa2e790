import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import chemistry, gop, paths, readout, sampling, training_windows
from nodeloom.operators.components import connected_components, has_path
from nodeloom.plans import config


def test_components_against_union_find(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    draw = random.Random(4)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2150)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), lambda d: d.checkpoint()).collect()}
    assert got == {x: root(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), lambda d: d.checkpoint()).count() == 0


def test_components_never_end_unfinished(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        connected_components(chain, limit=2)
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_paths_between_pairs_and_nodes_of_several_columns(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (None, 1)], "u long, v long")
    pairs = spark.createDataFrame([(1, 3, "x"), (1, 7, "x"), (5, 5, "x"), (5, 1, "x"), (None, 1, "x")], "a long, b long, node string")
    assert {(r.a, r.b): r.linked for r in has_path(edges, pairs).collect()} == {(1, 3): True, (1, 7): False, (5, 5): True, (5, 1): False, (None, 1): False}
    wide = edges.select(*(F.struct(F.lit("g").alias("gid"), F.col(c).alias("n")).alias(c) for c in "uv")).where("u.n IS NOT NULL")
    assert {(r.node.n, r.component.n) for r in connected_components(wide).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_stoichiometry_and_ratios(spark):
    atoms = spark.createDataFrame([("a", s) for s in "XXYZ"] + [("b", s) for s in "XY"], "structure_id string, symbol string")
    assert {(r.structure_id, r.symbol): r.fraction for r in chemistry.stoichiometry(atoms).collect()} == {("a", "X"): 0.5, ("a", "Y"): 0.25, ("a", "Z"): 0.25, ("b", "X"): 0.5, ("b", "Y"): 0.5}
    c = chemistry.compositions(atoms).toDF("s", "symbols", "fractions")
    pair = c.where("s = 'a'").select(F.col("symbols").alias("ms"), F.col("fractions").alias("mf")).crossJoin(c.where("s = 'b'"))
    for delta, want in ((0.3, True), (0.25, False), (0.1, False)):
        assert pair.select(chemistry.ratios_match(F.col("ms"), F.col("mf"), F.col("symbols"), F.col("fractions"), delta)).first()[0] is want
    assert spark.range(1).select(chemistry.reaction_enthalpy(F.lit(5.0), [F.lit(1.0), F.lit(2.0)])).first()[0] == 3.5
    with pytest.raises(ValueError, match="W"):
        chemistry.require_species(atoms, ["X", "W"])


def test_order_parameter_of_a_star_and_a_loner(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(5)], "gid int, node_id long")
    edges = spark.createDataFrame([(0, 0, i, 0.5) for i in (1, 2, 3)], "gid int, src long, dst long, weight double")
    star = 0.25 * math.log(0.25) + 1.5 * 0.25 + 0.75 * math.log(0.75) + 0.5 * 0.75
    for k in (1, 2):
        assert math.isclose(gop.order_parameter(nodes, edges, k).first().gop, star**k + 0.0)


def test_stars_join_what_edges_join(spark):
    draw = random.Random(8)
    rows = [(g, draw.randrange(60), draw.randrange(60)) for g in ("x", "y", None) for _ in range(45)] + [("z", i, i + 1) for i in range(80)]
    edges = spark.createDataFrame(rows, "gid string, src long, dst long")
    for most in (10**6, 5):
        found = {(r.gid, r.node_id): r.component for r in gop.linked_components(spark.createDataFrame(gop.stars(edges, ("gid",), most).collect(), edges.schema), ("gid",)).collect()}
        parent = {(g, n): n for g, u, v in rows for n in (u, v)}

        def root(g, n):
            while parent[g, n] != n:
                n = parent[g, n]
            return n

        for g, u, v in rows:
            a, b = root(g, u), root(g, v)
            parent[g, max(a, b)] = min(a, b)
        several = {(g, n) for g, u, v in rows if u != v for n in (u, v)}
        assert found == {(g, n): root(g, n) for g, n in several}


def test_order_parameter_ignores_numbering_and_place(spark):
    x = np.random.default_rng(2).uniform(0, 3, (12, 3))
    frame = lambda y, ids: spark.createDataFrame([(0, int(i), "AB"[j % 2], *map(float, v)) for j, (i, v) in enumerate(zip(ids, y))], "gid int, node_id long, symbol string, x double, y double, z double")
    values = [sorted(r.gop for r in gop.predict(frame(y, ids), [1.5, 2.5], [("A", "A"), ("A", "B")]).collect()) for y, ids in ((x, range(12)), (x + 7, reversed(range(12))))]
    assert np.allclose(*values, atol=1e-7)


def test_legacy_edges_beyond_the_cutoff(spark):
    nodes = spark.createDataFrame([(0, i, "A") for i in range(3)], "gid int, node_id long, symbol string")
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 3.0), (0, 1, 2, 2.5)], "gid int, src long, dst long, dist double")
    weights = lambda legacy: sorted(r.weight for r in gop.graph_pair_edges(nodes, edges, [2.0], [("A", "A")], legacy=legacy)[1].collect())
    assert weights(False) == [1.0] and weights(True) == [1.0, 2.5]


def test_samples_partition_their_input(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(c, 0.1, (n, 2)) for c, n in ((0, 60), (5, 7), (9, 33))])
    df = spark.createDataFrame([(i, v.tolist(), float(v[0]), float(v[1])) for i, v in enumerate(x)], "id long, x array<double>, a double, b double").cache()
    methods = {"random": {}, "property_binning": {"value": "a", "clusters": 5}, "grid": {"grids": 3, "columns": ("a", "b")}, "subgraph": {"neighbors": 3}, "kmeans": {"clusters": 3, "restarts": 2}, "gaussian_mixture": {"clusters": 3}, "birch": {"clusters": 3}, "spectral": {"clusters": 3}}
    for method, params in methods.items():
        got = sampling.sample(df, method, 0.3, 1, **params).select("id", "sampled").collect()
        assert sorted(r.id for r in got) == list(range(100)), method
        n = sum(r.sampled for r in got)
        assert n >= 30 and (method in ("property_binning", "grid", "subgraph", "birch", "spectral", "gaussian_mixture", "kmeans") or n == 30), (method, n)
        assert got and sorted(map(tuple, got)) == sorted(map(tuple, sampling.sample(df, method, 0.3, 1, **params).select("id", "sampled").collect())), method
    roles = sampling.three_way(df, 0.1, 0.2, 0.8).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in roles} == {"test": 10, "pretrain": 18, "training": 58, "validation": 14}


def test_draws_are_exact_whatever_the_ties(spark):
    df = spark.createDataFrame([(i // 3, "x" if i % 7 else None, i) for i in range(3000)], "id long, cluster string, __n int").repartition(5)
    for n in (0, 1, 500, 2999, 3000, 9000):
        got = sampling.first_rows(df, n, "id", 4)
        assert got.columns == ["id", "cluster", "__n", "drawn"] and got.where("drawn").count() == min(n, 3000) and got.count() == 3000
    per = sampling.first_rows(df, 100, "id", 4, ("cluster",)).where("drawn").groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in per} == {"x": 100, None: 100}
    want = sorted(range(1000), key=lambda i: hashlib.md5(f"4:{i}".encode()).hexdigest())[:50]
    assert {r.id for r in sampling.first_rows(df, 150, "id", 4).where("drawn").collect()} == set(want)


def test_running_sums_and_parts(spark):
    draw = random.Random(6)
    rows = [(i * 3, draw.randrange(0, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "part_id long, n long").repartition(7)
    total, want = 0, {}
    for i, n in rows:
        total += n
        want[i] = total
    for ranges in (1, 10, 2000):
        assert {r.part_id: r.upto for r in training_windows.running_sum(df, "n", "part_id", ranges=ranges).collect()} == want
    part = [i for i, n in rows for _ in range(n)]
    got = readout.part_of(spark.range(total + 5).withColumnRenamed("id", "ordinal"), df).collect()
    assert {r.ordinal: r.part_id for r in got} == dict(enumerate(part)) and len(got) == total
    assert readout.part_of(spark.range(5).withColumnRenamed("id", "ordinal"), df.limit(0)).count() == 0


def test_ratios_keep_other_columns(spark):
    rows = spark.createDataFrame([(0, "atom", 0, [1.0, 0.0], "X"), (0, "bond", 0, [3.0, 0.0], "Y")], "gid int, kind string, local_id int, value array<double>, type_key string")
    assert {(r.kind, r.dim, r.type_key, r.ratio) for r in readout.contribution_ratios(rows).collect()} == {("atom", 0, "X", 0.25), ("bond", 0, "Y", 0.75), ("atom", 1, "X", None), ("bond", 1, "Y", None)}


def test_quota_tops_up_and_takes_small_clusters(spark):
    df = spark.createDataFrame([(i, 0 if i < 2 else 1) for i in range(50)], "id long, cluster int")
    got = sampling.by_quota(df, 0.4, 3).collect()
    assert sum(r.sampled for r in got) == 20 and all(r.sampled for r in got if r.cluster == 0)


def test_path_through_a_line(spark):
    line = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, x array<double>")
    got = paths.latent_path(line, 0, 9, k=2).orderBy("order").collect()
    assert [r.x[0] for r in got] == list(map(float, range(10))) and np.allclose([r.gamma for r in got], np.linspace(0, 1, 10))
    two = paths.latent_path(line, 0, 9, k=2, version="2", reduction=0.25).orderBy("order").collect()
    assert all(a.gamma < b.gamma for a, b in zip(two, two[1:])) and two[0].gamma == 0 and two[-1].gamma == 1
    assert paths.latent_path(line, 0, 9, k=2, version="3", reduction=0.25).count() == 4
    near = {r.id: r.gamma for r in paths.path_coordinate(line, paths.latent_path(line, 0, 9, k=2)).collect()}
    assert math.isclose(near[3], 3 / 9)
    apart = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [50.0]), (3, [51.0])], "id long, x array<double>")
    assert paths.latent_path(apart, 0, 3, k=1).count() >= 2  # k grows until both ends meet


def test_walk_over_sorted_lists_and_few_searches(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(60, 3)) + np.repeat([[0.0, 0, 0], [9.0, 0, 0]], 30, 0)
    searches, found = [], paths.knn
    monkeypatch.setattr(paths, "knn", lambda points, k: (searches.append(k), found(points, k))[1])
    cloud = spark.createDataFrame([(1000 - 7 * i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    away = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for near in range(2, 60):  # the plain walk
        links = [set() for _ in x]
        for a in range(60):
            for b in sorted((b for b in range(60) if b != a), key=lambda b: (away[a, b], 1000 - 7 * b))[:near]:
                links[a].add(b), links[b].add(a)
        path, seen = [0], {0}
        while path and path[-1] != 59:
            step = next((b for b in sorted(links[path[-1]], key=lambda b: (away[path[-1], b], 1000 - 7 * b)) if b not in seen), None)
            path = path[:-1] if step is None else [*path, step]
            seen.add(step)
        if path:
            break
    got = paths.path_nodes(cloud, 1000, 1000 - 7 * 59, 2).orderBy("order").collect()
    assert [r.node for r in got] == [1000 - 7 * i for i in path] and [r.order for r in got] == list(range(len(path)))
    assert near > 20 and len(searches) <= 6  # one for each k before


def test_long_paths_are_summed_in_parts(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(500, 2)).tolist()
    path = spark.createDataFrame([(3 * i, v) for i, v in enumerate(x)], "order int, x array<double>")
    for legacy in (False, True):
        plain, parts = ([r.gamma for r in f(path, legacy=legacy).orderBy("order").collect()] for f in (paths.path_distances, paths.distances_along))
        assert len(parts) == 500 and np.allclose(plain, parts, rtol=0, atol=1e-12)
    monkeypatch.setattr(paths, "SHORT", 2)
    line = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, x array<double>")
    for version, n in ("1", 10), ("3", 4):
        assert [round(r.gamma, 9) for r in paths.latent_path(line, 0, 9, 2, version, 0.25).orderBy("order").collect()][-1] == 1 and paths.latent_path(line, 0, 9, 2, version, 0.25).count() == n


def test_legacy_path_distance(spark):
    square = spark.createDataFrame([(i, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])], "order int, x array<double>")
    plain, legacy = ([round(r.gamma, 6) for r in paths.path_distances(square, legacy=old).orderBy("order").collect()] for old in (False, True))
    wrap = math.sqrt(2)
    assert plain == [0, 0.5, 1] and np.allclose(legacy, np.array([wrap, wrap + 1, wrap + 2]) / (wrap + 2), atol=1e-6)


def test_gamma_refuses_what_repeats_itself(spark):
    with pytest.raises(ValueError):
        paths.assign_gammas(None, None, iterations=2)


def test_readout_rules(spark):
    rows = spark.createDataFrame([(0, "atom", 0, [1.0, 2.0]), (0, "bond", 0, [3.0, 4.0]), (1, "atom", 0, [5.0, 6.0])], "gid int, kind string, local_id int, value array<double>")
    assert {(r.gid, r.dim): r.value for r in readout.accumulated(rows).collect()} == {(0, 0): 4, (0, 1): 6, (1, 0): 5, (1, 1): 6}
    assert {r.dim: r.value for r in readout.accumulated(rows, "sum").collect()} == {0: 9, 1: 12}
    with pytest.raises(NotImplementedError):
        readout.accumulated(rows, "ensemble")


def test_worst_share_and_all(spark):
    rows = spark.createDataFrame([(0.0, float(v)) for v in (1, 2, 3, 4)], "pred double, y double")
    assert training_windows.worst_share_loss(rows, 0.5).first().loss == 12.5 and training_windows.worst_share_loss(rows, 0.5, legacy=True).first().loss == 7.5


def test_checkpoints_follow_both_losses(spark):
    log = [(5.0, 5.0), (4.0, 6.0), (4.5, 1.0), (3.0, 4.0), (2.0, 4.5), (1.0, 3.9)]
    rows = spark.createDataFrame([("r", i, *v) for i, v in enumerate(log)], "run_id string, epoch int, loss_train double, loss_valid double")
    want, best = [], [math.inf, math.inf]
    for a, b in log:
        ok = a < best[0] and b < best[1]
        best = [min(best[0], a), b if ok else best[1]]
        want.append(ok)
    assert [r.saved for r in training_windows.checkpoints(rows).orderBy("epoch").collect()] == want


def test_settings():
    run = config.Run(training=config.Training(epochs=3, frozen=("enc",)))
    assert config.Run.from_json(run.to_json()) == run
    for bad in (lambda: config.Sampling("x"), lambda: config.Model(conv="x"), lambda: config.Training(optimizer="x"), lambda: config.Sampling(split=2)):
        with pytest.raises(ValueError):
            bad()


def test_mixing_triples_by_the_rule_on_every_triple(spark):
    fractions = {"a": {"X": 0.6, "Y": 0.4}, "swapped": {"X": 0.4, "Y": 0.6}, "x": {"X": 1.0}, "foreign": {"W": 0.5, "Z": 0.5}, "half": {"X": 0.3, "W": 0.7}, "far": {"X": 0.9, "Y": 0.1}}
    fractions |= {"again": fractions["a"], "three": {"W": 0.2, "X": 0.5, "Y": 0.3}}
    energy = {name: float(i * i) for i, name in enumerate(fractions)}
    rows = [(name, sorted(f), [f[s] for s in sorted(f)], energy[name]) for name, f in fractions.items()]
    df = spark.createDataFrame(rows, "id string, symbols array<string>, fractions array<double>, energy double")

    def fits(main, other):
        both = [s for s in other if s in main]
        return all(abs(abs(main[x] - main[y]) - abs(other[x] - other[y])) < 0.15 for x in both for y in both)

    want = {
        (a, b, c): energy[a] - (energy[b] + energy[c]) / 2
        for a, f in fractions.items() for b, g in fractions.items() for c, h in fractions.items()
        if fits(f, g) and fits(f, h) and len(g.keys() | h.keys()) == len(f)
    }
    got = chemistry.mixing_triples(df, df, df, 0.15).collect()
    assert {tuple(r)[:3]: r.enthalpy for r in got} == want and len(got) == len(want)
    assert ("a", "swapped", "swapped") in want and ("a", "foreign", "foreign") in want and ("a", "far", "far") not in want


def test_gammas_over_several_rounds_search_once(spark, monkeypatch):
    """All rounds share one search of the points' neighbors, which the result's plan holds no more."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    path = spark.createDataFrame([(i, [float(i), 0.0, 0.0], i / 4) for i in range(5)], "order int, x array<double>, gamma double")
    searches, search = [], paths.knn
    monkeypatch.setattr(paths, "knn", lambda *a, **kw: searches.append(a) or search(*a, **kw))
    found = paths.assign_gammas(points, path, "2", 3, iterations=4, cutoff=3.0)
    assert len(searches) == 1 and "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {r.id: r.gamma for r in paths.assign_gammas(points, path, "2", 3, cutoff=3.0).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(dist, 1)[:, :4]  # the point itself first
    w = np.take_along_axis(dist, near, 1)
    w = np.where(w < 1e-3, 1, np.where(w < 3, 0.5 * (np.cos(np.pi / 3 * w) + 1), 0))
    gamma = np.array([want[i] for i in range(60)])
    for _ in range(3):
        gamma = (w * gamma[near]).sum(1) / 4
    assert np.allclose([r.gamma for r in sorted(found.collect())], gamma)
