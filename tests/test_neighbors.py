"""Periodic images, half stencils, nearest neighbors by cells and band joins, against brute force."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import chemistry, neighbors

CELL = [[7.0, 0, 0], [1.5, 6.0, 0], [0.4, -0.7, 8.0]]


def frame(spark, x, gid=0):
    return spark.createDataFrame([(gid, i, *map(float, v), "ab"[i % 2]) for i, v in enumerate(x)], "gid long, node_id long, x double, y double, z double, kind string")


@pytest.mark.parametrize("method", ["cells", "group"])
@pytest.mark.parametrize("periodic", [(True, True, True), (True, False, True), (False, False, False)])
@pytest.mark.parametrize("cutoff", [2.5, 9.0])
def test_images_of_atoms_anywhere(spark, method, periodic, cutoff):
    """Atoms far outside of an oblique cell, some at one place; the cutoff may exceed the cell."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-12, 20, (14 if cutoff > 5 else 40, 3))
    x[5] = x[4]
    m, most = np.array(CELL), 12
    want = {}
    reach = [range(-most, most + 1) if p else (0,) for p in periodic]
    shifts = np.array(list(itertools.product(*reach)))
    moved = shifts @ m
    for a in range(len(x)):
        for b in range(len(x)):
            d = x[b] + moved - x[a]
            for i in np.flatnonzero((d**2).sum(1) < cutoff**2):
                if a != b or shifts[i].any():
                    want[a, b, *map(int, shifts[i])] = d[i]
    got = neighbors.radius_graph(frame(spark, x), cutoff, CELL, periodic, method=method, carry=("kind",)).collect()
    assert len(got) == len(want)
    for r in got:
        d = want[r.src, r.dst, r.sx, r.sy, r.sz]
        assert np.allclose([r.dx, r.dy, r.dz], d) and r.dist == pytest.approx(np.sqrt((d**2).sum())) and (r.src_kind, r.dst_kind) == ("ab"[r.src % 2], "ab"[r.dst % 2])
    apart = neighbors.radius_graph(frame(spark, x), cutoff, CELL, periodic, self_images=False, method=method)
    assert apart.count() == sum(a != b for a, b, *_ in want)


def test_few_images(spark):
    rng = np.random.default_rng(5)
    own = neighbors.wrapped(frame(spark, rng.uniform(0, 50, (1000, 3))), [[50.0, 0, 0], [0, 50.0, 0], [0, 0, 50.0]], (True,) * 3)
    n = neighbors.halo(own, [[50.0, 0, 0], [0, 50.0, 0], [0, 0, 50.0]], (True,) * 3, 4.0).count()
    assert 1000 < n < 1000 * (1 + 8 / 50) ** 3 * 1.1


def test_half_of_the_cubes():
    assert len(neighbors.HALF) == 14 and len(neighbors.ALL) == 27
    assert {*neighbors.HALF, *(tuple(-v for v in o) for o in neighbors.HALF)} == set(neighbors.ALL)


def nearest(x, y, ids, k, itself, positive):
    out = set()
    for i, v in enumerate(x):
        d = np.sqrt(((y - v) ** 2).cumsum(1)[:, -1])
        order = [j for j in np.lexsort((ids, d)) if not (itself and ids[j] == i) and not (positive and d[j] == 0)][:k]
        out |= {(i, int(ids[j]), r, round(float(d[j]), 9)) for r, j in enumerate(order, 1)}
    return out


def got(df):
    return {(r.src, r.dst, r.rank, round(r.dist, 9)) for r in df.collect()}


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>").repartition(3)


@pytest.mark.parametrize("most_bytes,cell_rows", [(20_000, 40), (4_000, 500), (1_500, 8)])
def test_nearest_by_cells(spark, monkeypatch, most_bytes, cell_rows):
    """Groups, a third of all at one place, and ties: units of all sizes give the rows that brute force does."""
    monkeypatch.setattr(neighbors, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(cell_rows)
    x = np.round(rng.normal(size=(8, 5))[rng.integers(0, 8, 400)] * 10 + rng.normal(size=(400, 5)), 1)
    x[::3] = x[0]
    df, ids = points(spark, x), np.arange(400)
    found = neighbors.knn_by_cells(df.select("node_id", "x"), df.select("node_id", "x"), 4, 400, 5, True, False, most_bytes, cell_rows)
    want = nearest(x, x, ids, 4, True, False)
    best = {}
    for r in found.collect():
        best.setdefault(r.src, []).append((r.dist, r.dst))
    assert {(s, d, i, round(v, 9)) for s, all_ in best.items() for i, (v, d) in enumerate(sorted(all_)[:4], 1)} == want
    assert got(neighbors.knn(df, 4, most_bytes=most_bytes)) == want == got(neighbors.knn(df, 4))
    few = x[:60] + 0.05
    asks = points(spark, few)
    assert got(neighbors.knn(asks, 3, df, positive=True, most_bytes=most_bytes)) == nearest(few, x, ids, 3, False, True) == got(neighbors.knn(asks, 3, df, positive=True))
    assert got(neighbors.knn(df.where("node_id < 3"), 5, most_bytes=8)) == nearest(x[:3], x[:3], ids[:3], 5, True, False)


def test_few_copies_of_a_point(spark, monkeypatch):
    """On points in groups a point goes to few units, though there are many."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 6000)] * 50 + rng.normal(size=(6000, 6))
    copies, visits = [], neighbors.visits
    monkeypatch.setattr(neighbors, "visits", lambda known, cells: copies.append((visits(known, cells), cells.value.units)) or copies[-1][0])
    found = neighbors.knn(points(spark, x), 3, most_bytes=6000 * 8 * 6 // 30)
    (sent, units), dealt = copies[0], [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert units > 25 and sent.count() < 2 * 6000
    assert len(dealt) == 1 and re.search(r"\], (\d+)", dealt[0])[1] == str(units)
    assert found.count() == 18_000
    some = rng.choice(6000, 50, replace=False)
    far = {(r.src, r.rank): r.dist for r in found.where(F.col("src").isin(some.tolist())).collect()}
    for i in some:
        d = np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[1:4]
        assert np.allclose([far[int(i), r] for r in (1, 2, 3)], d)


def test_reached_cells_hold_what_is_near():
    """Cells that are passed over hold nothing within the radius; on groups, few are not."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))[rng.integers(0, 30, 3000)] * 30 + rng.normal(size=(3000, 4))
    pivots = x[:60]
    d = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2))
    cell = d.argmin(1)
    away = d[np.arange(3000), cell]
    low, high = np.array([away[cell == c].min() for c in range(60)]), np.array([away[cell == c].max() for c in range(60)])
    cells = neighbors.Cells(pivots, np.bincount(cell, minlength=60), low, high, 200)
    asks = x[rng.choice(3000, 300, replace=False)]
    radius = np.sort(np.sqrt(((asks[:, None] - x[None]) ** 2).sum(2)), 1)[:, 5]
    home = np.sqrt(((asks[:, None] - pivots[None]) ** 2).sum(2)).argmin(1)
    reached = cells.reached(cells.distances(asks), home, radius)
    for i, v in enumerate(asks):
        near = np.flatnonzero(np.sqrt(((x - v) ** 2).sum(1)) <= radius[i])
        assert reached[i, cell[near]].all()
    assert reached.sum(1).mean() < 6


def compositions(spark, rng, n, symbols, parts):
    rows = set()
    while len(rows) < n:
        chosen = sorted(rng.choice(symbols, parts, replace=False).tolist())
        f = rng.dirichlet(np.ones(parts)).round(4).tolist()
        rows.add((tuple(chosen), tuple(f)))
    return [(list(s), list(f)) for s, f in rows]


def test_ten_thousand_compositions(spark):
    rng = np.random.default_rng(4)
    rows = compositions(spark, rng, 10_000, ["Co", "Cu", "Fe", "Mo"], 4)
    df = spark.createDataFrame(rows, "symbols array<string>, fractions array<double>")
    a, b = (df.select(F.col("symbols").alias(f"{n}_symbols"), F.col("fractions").alias(f"{n}_fractions")) for n in "ab")
    met = chemistry.matching_compositions(a, b, 0.004)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    f = np.array([r[1] for r in rows])
    i, j = np.triu_indices(4, 1)
    gaps, want = np.abs(f[:, i] - f[:, j]), 0
    for at in range(0, len(gaps), 500):
        near = np.abs(gaps[at : at + 500, None, 0] - gaps[None, :, 0]) < 0.004
        x, y = np.nonzero(near)
        want += ((gaps[y] < gaps[at + x] + 0.004) & (gaps[y] > gaps[at + x] - 0.004)).all(1).sum()
    assert met.count() == want > 10_000


def test_triples_against_all_of_them(spark):
    """Compositions of one to five symbols that share many, some or none."""
    rng = np.random.default_rng(9)
    rows = [(k, *c, float(k)) for k, c in enumerate([*compositions(spark, rng, 8, list("ABCD"), 3), *compositions(spark, rng, 8, list("ABCDEF"), 2), *compositions(spark, rng, 6, list("ABCDE"), 4), (["A"], [1.0]), (["Z"], [1.0])])]
    df = spark.createDataFrame(rows + [(99, rows[0][1], rows[0][2], 7.0)], "id long, symbols array<string>, fractions array<double>, energy double")
    rows.append((99, rows[0][1], rows[0][2], 7.0))

    def fits(a, b):
        there = dict(zip(a[1], a[2]))
        return all(s not in there or t not in there or abs(abs(f - g) - abs(there[s] - there[t])) < 0.3 for s, f in zip(b[1], b[2]) for t, g in zip(b[1], b[2]))

    want = {(a[0], b[0], c[0]) for a in rows for b in rows if fits(a, b) for c in rows if fits(a, c) and len(a[1]) == len({*b[1], *c[1]})}
    found = chemistry.mixing_triples(df, df, df, 0.3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    out = [(r.a_id, r.b_id, r.c_id) for r in found.collect()]
    assert len(out) == len(want) and set(out) == want


@pytest.mark.parametrize("small", [0, 20, 1000])
def test_small_groups_are_not_dealt_into_cubes(spark, monkeypatch, small):
    """Groups of 5 and 30 atoms: the same pairs wherever the border lies; no row for a cube where a group is small, and few cubes for images where it is not."""
    rng, dealt, real = np.random.default_rng(8), [], neighbors.around
    atoms = frame(spark, rng.uniform(-3, 15, (5, 3)), 1).unionByName(frame(spark, rng.uniform(-3, 15, (30, 3)), 2)).cache()
    want = sorted(neighbors.radius_graph(atoms, 4.0, CELL, method="group").select("gid", "src", "dst", "sx", "sy", "sz").collect())
    monkeypatch.setattr(neighbors, "SMALL_GROUP", small)
    monkeypatch.setattr(neighbors, "around", lambda *a: dealt.append(real(*a)) or dealt[-1])
    got = sorted(neighbors.radius_graph(atoms, 4.0, CELL, method="cells").select("gid", "src", "dst", "sx", "sy", "sz").collect())
    assert want and got == want
    n = {0: 35, 20: 30, 1000: 0}[small]
    half, images = (df.count() for df in dealt)
    assert half == 14 * n and (images > 0) == (n > 0)
    assert dealt[1].where(neighbors.cubes_of_cell(CELL, (True, True, True), 4.0)).count() * 2 <= images


@pytest.mark.parametrize("kind", ["unit", "grid", "far", "outlier", "tiny", "huge", "copies", "repeated ids"])
def test_single_precision_loses_no_neighbor(kind):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(5000, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ids = rng.permutation(5000) // (7 if kind == "repeated ids" else 1)
    x = {"grid": rng.integers(0, 3, (5000, 6)).astype(float), "far": unit + 1e7, "outlier": np.where(np.arange(5000)[:, None] == 0, 1e9, unit), "tiny": unit * 1e-150, "huge": unit * 1e150, "copies": unit[rng.integers(0, 60, 5000)], "repeated ids": unit[ids]}.get(kind, unit)
    x[17, 2] = np.nan
    for k, itself, positive in ((1, True, False), (4, True, False), (3, False, True)):
        found, far = neighbors.Held(ids, x, k).nearest(ids[:40], x[:40], k, itself, positive)
        for i in range(40):
            d = np.sqrt(((x - x[i]) ** 2).cumsum(1)[:, -1])
            d[~np.isfinite(d) | (itself & (ids == ids[i])) | (positive & (d == 0))] = np.inf
            first = np.lexsort((ids, d))[:k]
            assert (far[i] == d[first]).all() and (found[i] == np.where(np.isinf(d[first]), -1, ids[first])).all()


def test_a_search_does_not_stay_in_the_tasks_of_its_file(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(3000, 6))
    df = points(spark, x).coalesce(1)
    expected = neighbors.knn(df, 3).collect()
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 1_000_000)
    found = neighbors.knn(df, 3)
    assert re.search(r"RepartitionByExpression \[node_id#\d+L?\], 10", found._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(found.collect()) == sorted(expected)


def test_edges_of_lists_search_once(spark):
    from nodeloom.plans import catalogue

    found = catalogue.QUERIES["generic_pairwise_edges"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_of_many_booleans():
    rng = np.random.default_rng(9)
    for shape in ((0, 5), (1, 1), (3, 7), (8, 8), (5, 13), (64, 1000)):
        for share in (0, 0.001, 0.5, 1):
            x = rng.random(shape) < share
            assert np.array_equal(neighbors.true_at(x), np.flatnonzero(x))


def test_visits_are_counted_without_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4))[rng.integers(0, 12, 900)] * 6 + rng.normal(size=(900, 4))
    seen, visits = [], neighbors.visits
    monkeypatch.setattr(neighbors, "visits", lambda *a: seen.append(a) or visits(*a))
    neighbors.knn(points(spark, x), 2, most_bytes=900 * 8 * 4 // 6)
    (known, cells), = seen
    counted = neighbors.visitors(known, cells)
    assert len(counted) > 3 and counted == {r.unit: r["count"] for r in visits(known, cells).groupBy("unit").count().collect()}
    assert neighbors.visitors(known.limit(0), cells) == {}
