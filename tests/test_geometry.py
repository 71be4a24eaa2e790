import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.functions import basis, geometry, vectors
from nodeloom.operators import graphs, neighbors
from nodeloom.sources import structures, tables


def points(spark, rows, gid=0):
    return spark.createDataFrame([(gid, i, *map(float, r)) for i, r in enumerate(rows)], "gid int, node_id long, x double, y double, z double")


def fcc(cells, a):
    corner = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]
    return [((i + u) * a, (j + v) * a, (k + w) * a) for i in range(cells) for j in range(cells) for k in range(cells) for u, v, w in corner]


def brute(rows, cutoff, cell, periodic):
    """Ordered pairs over all images that can matter, one by one."""
    x, m = np.array(rows, float), np.array(cell, float)
    reach = [range(-6, 7) if p else (0,) for p in periodic]  # atoms may lie several cells apart
    out = set()
    for s in ((i, j, k) for i in reach[0] for j in reach[1] for k in reach[2]):
        d = np.linalg.norm(x[None] + np.array(s) @ m - x[:, None], axis=2)
        out |= {(int(a), int(b), *s) for a, b in zip(*np.nonzero(d < cutoff)) if a != b or s != (0, 0, 0)}
    return out


@pytest.mark.parametrize("method", ["cells", "group"])
@pytest.mark.parametrize("periodic", [(True, True, True), (True, False, False)])
@pytest.mark.parametrize("cell", [[[4, 0, 0], [0, 5, 0], [0, 0, 6]], [[4, 0, 0], [2, 4, 0], [1, -1, 5]], [[1.5, 0, 0], [0, 9, 0], [0, 0, 9]]])
def test_radius_graph_with_images(spark, method, periodic, cell):
    rows = np.random.default_rng(1).uniform(0, 4, (12, 3))
    got = neighbors.radius_graph(points(spark, rows), 2.3, cell, periodic, method=method).collect()
    assert {(r.src, r.dst, r.sx, r.sy, r.sz) for r in got} == brute(rows, 2.3, cell, periodic) and len(got) == len({(r.src, r.dst, r.sx, r.sy, r.sz) for r in got})
    for r in got:
        assert math.isclose(r.dist, math.sqrt(r.dx**2 + r.dy**2 + r.dz**2))


def test_fcc_shells_and_line_graph(spark):
    """12 + 6 neighbors each within 4.0 of an 864-atom cell, and d * (d - 1) ordered pairs of edges at each atom."""
    a = 22.47 / 6
    e = neighbors.radius_graph(points(spark, fcc(6, a)), 4.0, [[22.47, 0, 0], [0, 22.47, 0], [0, 0, 22.47]]).cache()
    assert e.count() == 15_552
    assert e.groupBy("src").count().agg(F.min("count"), F.max("count")).first() == (18, 18)
    assert graphs.line_graph(graphs.with_edge_ids(e)).count() == 264_384


def test_two_atoms_in_a_box(spark):
    e = neighbors.radius_graph(points(spark, [(0, 0, 0), (1, 0, 0)]), 2.1, [[2.0, 0, 0], [0, 9, 0], [0, 0, 9]])
    found = sorted((r.src, r.dst, round(r.dist, 6)) for r in e.collect())
    assert found == sorted([(0, 1, 1.0)] * 2 + [(1, 0, 1.0)] * 2 + [(0, 0, 2.0)] * 2 + [(1, 1, 2.0)] * 2)
    assert neighbors.radius_graph(points(spark, [(0, 0, 0), (1, 0, 0)]), 2.1, [[2.0, 0, 0], [0, 9, 0], [0, 0, 9]], self_images=False).count() == 4


def test_angles(spark):
    triangle = graphs.atomic_graph(points(spark, [(0, 0, 0), (1, 0, 0), (0.5, math.sqrt(3) / 2, 0)]), 1.1)
    assert all(abs(r.angle - math.pi / 3) < 1e-9 for r in triangle["angles"].collect()) and triangle["angles"].count() == 6
    line = graphs.atomic_graph(points(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)]), 1.1)
    assert [r.angle for r in line["angles"].collect()] == [math.pi] * 2
    for turn in (1.2, math.pi / 2, math.pi, 2.0):
        chain = [(0, 1, 0), (0, 0, 0), (0, 0, 1), (math.sin(turn), math.cos(turn), 1)]
        found = [r.angle for r in graphs.dihedrals(graphs.with_edge_ids(neighbors.radius_graph(points(spark, chain), 1.05))).collect()]
        assert len(found) == 2 and all(abs(abs(v) - turn) < 1e-9 for v in found)


def test_legacy_angle_scale(spark):
    cloud = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0])], "gid int, node_id long, x array<double>")
    e = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 2, 0)], "gid int, edge_id int, src int, dst int")
    assert abs(graphs.three_body_angles(e, cloud).first().angle - math.pi / 2) < 1e-9
    assert abs(graphs.three_body_angles(e, cloud, legacy_scale=True).first().angle - math.pi / 2 * math.pi / 180) < 1e-9


def test_minimum_image_in_a_cell(spark):
    cell = [[4.0, 0, 0], [1.0, 3.0, 0], [0, 0, 5.0]]
    d = np.array([3.6, 0.2, -4.9])
    row = spark.range(1).select(*geometry.minimum_image_cell(tuple(F.lit(float(v)) for v in d), cell)).first()
    f = d @ np.linalg.inv(np.array(cell))
    assert np.allclose(row, (f - np.round(f)) @ np.array(cell))


def test_knn_blocks_ties_and_duplicates(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 3, (60, 3)).astype(float)  # many ties and equal points
    cloud = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>")
    want = set()
    for i in range(60):
        near = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in range(60) if j != i)[:4]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    for most in (64_000_000, 400):
        assert {(r.src, r.dst, r.rank) for r in neighbors.knn(cloud, 4, most_bytes=most).collect()} == want


def test_neighbors_by_radius_need_enough(spark):
    e = neighbors.radius_graph(points(spark, [(0, 0, 0), (1, 0, 0), (5, 0, 0)]), 1.5)
    assert neighbors.nearest_of(e, 1).count() == 2
    with pytest.raises(Exception, match="fewer neighbors"):
        neighbors.nearest_of(e, 2).collect()


def test_ego_graph_of_a_star(spark):
    e = graphs.with_edge_ids(neighbors.radius_graph(points(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (-1, 0, 0)]), 1.1))
    center = sorted((r.src, r.dst) for r in graphs.ego_graphs(e).where("center = 0").collect())
    assert center == sorted([(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0)])


def test_joined_graph_offsets(spark):
    one = points(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    g = graphs.joined_graph([one, one], 1.1)
    edges = {r.edge_id: r for r in g["edges"].collect()}
    assert sorted(edges) == list(range(8)) and {r.node_id for r in g["nodes"].collect()} == set(range(6))
    for a in g["angles"].collect():
        assert edges[a.edge_u].part_id == edges[a.edge_v].part_id == a.part_id and edges[a.edge_u].dst == edges[a.edge_v].dst


def test_graph_id_ignores_row_order(spark):
    e = graphs.with_edge_ids(neighbors.radius_graph(points(spark, np.random.default_rng(0).uniform(0, 3, (9, 3))), 2))
    a, b = (graphs.graph_id(x).first().content_id for x in (e, e.orderBy(F.rand())))
    assert a == b and len(a) == 128


def test_basis(spark):
    x = np.linspace(0.1, 2, 7)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", basis.bessel(F.col("x"), 0, 3, 4).alias("b"), basis.gaussian(F.col("x"), 0, 2, 5).alias("g"), basis.random_fourier(F.col("x"), 6, seed=2).alias("f")).collect()
    n, c = np.arange(1, 5), np.linspace(0, 2, 5)
    for r in rows:
        at = r.x + 1e-5
        assert np.allclose(r.b, math.sqrt(2 / 3) * np.sin(n * math.pi * at / 3) / at) and np.allclose(r.g, np.exp(-(((r.x - c) / 0.5) ** 2)) / 1.12)
        assert np.allclose(np.array(r.f[:3]) ** 2 + np.array(r.f[3:]) ** 2, 1)


def test_vectors(spark):
    row = spark.range(1).select(vectors.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vectors.angle_between(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-2.0), F.lit(0.0))).alias("a"), vectors.unit(F.array(F.lit(0.0))).alias("z")).first()
    assert row.u == [0.6, 0.8] and row.a == math.pi and row.z == [None]


POSCAR = "Co Mo\n 2.0\n 1 0 0\n 0 1.5 0\n 0 0 2\n Co Mo\n 2 1\nDirect\n 0 0 0\n 0.5 0.5 0.5\n 0.25 0 0\n"


def test_structure_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.poscar").write_text(POSCAR)
    got = structures.read_poscar(spark, str(tmp_path / "in" / "one.poscar"))
    row = got.first()
    assert row.structure_id == "one" and row.cell == [[2, 0, 0], [0, 3, 0], [0, 0, 4]] and row.symbols == ["Co", "Co", "Mo"] and row.positions[1] == [1, 1.5, 2]
    atoms = structures.atoms_of(got).withColumn("label", F.col("node_id") * 10)
    structures.write_extxyz(structures.labelled_extxyz(atoms, got.select("structure_id", "cell"), 4.0), str(tmp_path / "out"))
    back = structures.read_extxyz(spark, str(tmp_path / "out/structure_id=one/*.txt")).first()
    assert back.cell == row.cell and back.symbols == row.symbols and back.positions == row.positions
    (tmp_path / "log").write_text("x\n   1 F= -.8110E+04 E0= 1\n  2 F= -.8120E+04 E0= 1 d E =0\n")
    assert structures.final_energies(structures.read_energies(spark, str(tmp_path / "log"))).first().energy == -8120.0


def test_clouds_are_reproducible(spark):
    a, b = (tables.random_clouds(spark, 5, 10, 20, 3)[0].orderBy("gid", "node_id").collect() for _ in range(2))
    assert a == b and len(a) == sum((10, 12, 15, 17, 20)) and all(-1 <= v <= 1 for r in a for v in r.x)


def test_blocks_of_vectors_meet(spark):
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(0, 1, (60, 3)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>").repartition(3)
    few = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(x[:10])], "node_id long, x array<double>")
    rows = lambda f: sorted((r.src, r.rank, r.dst, round(r.dist, 9)) for r in f.collect())
    for most in (24 * 60 // 4, 24 * 60 // 7):
        assert rows(neighbors.knn(df, 4, most_bytes=most)) == rows(neighbors.knn(df, 4))
        assert rows(neighbors.knn(df, 2, few, positive=True, most_bytes=most // 5)) == rows(neighbors.knn(df, 2, few, positive=True))
    assert neighbors.knn(df.limit(0), 3).count() == 0


def test_minimum_images_in_cells_and_groups(spark):
    draw = np.random.default_rng(3)
    x = draw.uniform(-5, 25, (150, 3))
    df = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(x)], "gid int, node_id long, x double, y double, z double")
    rows = lambda f: sorted((r.gid, r.src, r.dst, *(round(r[c], 9) for c in ("dist", "dx", "dy", "dz"))) for r in f.collect())
    for box in ((20.0, 20.0, 20.0), (20.0, None, 13.0), (None, None, None), (20.0, 7.0, 20.0)):
        cells, group = (rows(neighbors.minimum_image_graph(df, 4.0, box, method=m)) for m in ("cells", "group"))
        assert cells == group and len(cells) > 100


def test_edges_of_one_large_graph(spark):
    draw = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in draw.integers(0, 300, (900, 2))})
    got = graphs.with_edge_ids_of_one(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()
    assert sorted((r.edge_id, r.src, r.dst) for r in got) == [(i, *e) for i, e in enumerate(edges)]


def test_carried_columns(spark):
    df = spark.createDataFrame([(0, 0, "A", 0.0), (0, 1, "B", 1.0), (0, 2, "C", 9.0)], "gid int, node_id long, symbol string, x double").selectExpr("*", "0D AS y", "0D AS z")
    for method in ("cells", "group"):
        assert {(r.src_symbol, r.dst_symbol) for r in neighbors.radius_graph(df, 2.0, method=method, carry=("symbol",)).collect()} == {("A", "B"), ("B", "A")}


OUTCAR = """ vasp.5.4.4
   VRHFIN =Co: d8 s1
   VRHFIN =Mo: 4d55s1
 SYSTEM = two of a kind
   ions per type =               2   1
      direct lattice vectors                 reciprocal lattice vectors
     4.000000000  0.000000000  0.000000000     0.250000000  0.000000000  0.000000000
     0.000000000  5.000000000 -0.500000000     0.000000000  0.200000000  0.000000000
     0.000000000  0.000000000  6.000000000     0.000000000  0.000000000  0.166666667
  free energy    TOTEN  =        -1.00000000 eV
 POSITION                                       TOTAL-FORCE (eV/Angst)
 -----------------------------------------------------------------------------------
      0.00000      0.00000      0.00000         0.100000     -0.200000      0.300000
      1.00000      2.00000      3.00000         0.000000      0.000000      0.000000
     -1.50000      2.50000      0.00000        -0.100000      0.200000     -0.300000
 -----------------------------------------------------------------------------------
  FREE ENERGIE OF THE ION-ELECTRON SYSTEM (eV)
  free  energy   TOTEN  =       ENERGY eV
  energy  without entropy=      -9.00000000  energy(sigma->0) =       -8.50000000
"""


def test_outcar(spark, tmp_path):
    (tmp_path / "A").mkdir()
    second = OUTCAR[OUTCAR.index(" POSITION") :].replace("1.00000      2.00000", "1.25000      2.00000").replace("-8.5", "-8.75")
    (tmp_path / "A" / "OUTCAR").write_text(OUTCAR.replace("ENERGY", "-8.25") + second.replace("ENERGY", "-8.5"))
    (tmp_path / "A" / "OUTCAR.cut").write_text(OUTCAR.replace("ENERGY", "-8.25") + second[:200])
    (tmp_path / "A" / "OUTCAR.none").write_text("nothing")
    got = {r.structure_id: r for r in structures.read_outcar(spark, str(tmp_path / "A")).collect()}
    assert set(got) == {"A/OUTCAR", "A/OUTCAR.cut"}
    r = got["A/OUTCAR"]
    assert (r.step, r.energy, r.free_energy, r.symbols, r.comment) == (1, -8.75, -8.5, ["Co", "Co", "Mo"], "two of a kind")
    assert r.positions[1] == [1.25, 2.0, 3.0] and r.cell[1] == [0.0, 5.0, -0.5] and r.forces[2] == [-0.1, 0.2, -0.3] and got["A/OUTCAR.cut"].step == 0
    assert structures.read_outcar(spark, str(tmp_path / "A"), last=False).count() == 3
    assert structures.atoms_of(structures.read_outcar(spark, str(tmp_path / "A/OUTCAR"))).count() == 3


def test_places_by_bisection(spark):
    from nodeloom.functions.search import place_in

    values = spark.createDataFrame([(v,) for v in [None, *range(-2, 40)]], "x long")
    for n in (0, 1, 2, 3, 7, 8, 9, 30):
        bounds = list(range(0, n))
        got = values.select("x", place_in(bounds, F.col("x")).alias("p")).collect()
        assert all(r.p == (0 if r.x is None else sum(b <= r.x for b in bounds)) for r in got)
