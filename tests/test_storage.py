"""What is written: bucketed graphs, structures in frames, the shared folder."""

import math
import os

import pytest
from pyspark.sql import functions as F

from nodeloom import storage
from nodeloom.plans import catalogue
from nodeloom.sources import structures, tables

SF = "/root/testdata/sf0.001"


def test_no_shuffle_over_buckets(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    nodes = spark.range(200).select((F.col("id") % 20).alias("gid"), F.floor(F.col("id") / 20).alias("node_id"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"))
    edges = nodes.select("gid", F.col("node_id").alias("src"), F.pmod(F.col("node_id") + 1, F.lit(10)).alias("dst"))
    tables.write_graph({"nodes": nodes, "edges": edges}, str(tmp_path / "g"), 4, "bucketed")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = tables.bond_symbols(spark.table("bucketed.edges"), spark.table("bucketed.nodes"))
    sums = found.groupBy("gid", "src_symbol", "dst_symbol").count()
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    plain = tables.bond_symbols(edges, nodes)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and plain.count() == 200
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == held


def frames(n, atoms=5):
    out = []
    for i in range(n):
        rows = "\n".join(f"{'Fe' if j else 'Co'} {i + j / 10:.6f} {j:.6f} {-i:.6f}" for j in range(atoms + i % 2))
        out.append(f'{atoms + i % 2}\nLattice="{10 + i} 0 0 0 20 0 0 0 30" Properties=species:S:1:pos:R:3\n{rows}')
    return "\n".join(out) + "\n"


def test_frames_of_large_files(spark, tmp_path):
    """Files of many frames are read by many tasks, and give what reading them whole gives."""
    (tmp_path / "a.xyz").write_text(frames(700))
    (tmp_path / "b.xyz").write_text(frames(3))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = structures.read_extxyz_frames(spark, str(tmp_path / "*.xyz"))
        got = {(r.path.rsplit("/", 1)[-1], r.step): r for r in found.collect()}
        assert spark.read.option("lineSep", 'Lattice="').text(str(tmp_path / "a.xyz")).select(F.spark_partition_id()).distinct().count() > 10
        few = structures.read_extxyz_frames(spark, str(tmp_path / "a.xyz"), ("cell",))
        assert few.columns == ["path", "step", "cell"] and few.count() == 700
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 703
    for name, n in (("a", 700), ("b", 3)):
        for i, (comment, cell, symbols, positions) in enumerate(structures.parse_extxyz((tmp_path / f"{name}.xyz").read_text())):
            r = got[f"{name}.xyz", i]
            assert (r.comment, r.cell, r.symbols, r.positions) == (comment, cell, symbols, positions)


def test_steps_of_large_outcars(spark, tmp_path):
    """As the reader of whole files has them; cells change on the way, and a step without energies is left out."""
    rows = [("x", i, "a run", [[10.0 + i // 7, 0.0, 0.0], [0.0, 11.0, 0.0], [0.0, 0.0, 12.0]], ["Fe", "Fe", "Co"], [[i + j / 8, 0.5, -1.0] for j in range(3)], [[0.0, j / 4, -0.5] for j in range(3)], -5.0 - i, -5.5 - i) for i in range(300)]
    df = spark.createDataFrame(rows, "structure_id string, step int, comment string, cell array<array<double>>, symbols array<string>, positions array<array<double>>, forces array<array<double>>, energy double, free_energy double")
    text = structures.outcar_text(df).first().value
    cut = text.rindex("  free  energy")
    (tmp_path / "one").mkdir()
    (tmp_path / "one/OUTCAR").write_text(text[:cut])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = structures.read_outcar_frames(spark, str(tmp_path / "one/OUTCAR")).orderBy("step").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = structures.parse_outcar(text[:cut])
    assert len(got) == len(want) == 299
    for r, (comment, cell, symbols, positions, step, energy, free, forces) in zip(got, want):
        assert (r.comment, r.cell, r.symbols, r.positions, r.step, r.forces) == (comment, cell, symbols, positions, step, forces)
        assert math.isclose(r.energy, energy) and math.isclose(r.free_energy, free)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(Session())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_leave_nothing_that_clear_does_not_know(spark):
    for name in ("graph_sink", "sample_grid", "epoch_log"):
        assert catalogue.QUERIES[name](spark, SF).count() > 0
    paths = [p.removeprefix("file:") for p in storage._written]
    assert any(map(os.path.exists, paths))
    storage.clear(spark)
    assert not any(map(os.path.exists, paths)) and storage._written == []


def test_frames_leave_in_pieces(monkeypatch):
    """What is parsed of one batch doesn't pile up in a task's Python."""
    import pandas as pd

    taken = []

    class Text:
        def mapInPandas(self, run, schema):
            taken.append(run)
            raise StopIteration

    monkeypatch.setattr(structures, "_records", lambda *a: (Text(), None))
    monkeypatch.setattr(structures, "PIECE", 1000, raising=False)
    with pytest.raises(StopIteration):
        structures.read_extxyz_frames(None, "")
    value = '1 0 0 0 1 0 0 0 1" of="x"\n' + "\n".join(f"C {i}.5 0 1" for i in range(20)) + "\n20\n"
    given = pd.DataFrame({"path": "a", "block": 0, "value": ["20\n"] + [value] * 50})
    out = [len(p) for p in taken[0](iter([given]))]
    assert sum(out) == 50 and max(out) <= 1000 // len(value) + 1


def test_runs_share_folders(spark, tmp_path):
    """Many runs take no more folders than a few, and runs that are there already are replaced, others not."""
    epochs = spark.range(1500).selectExpr("cast(id % 500 AS string) AS run_id", "id div 500 AS epoch", "1.0 AS loss_train", "2.0 AS loss_valid", "3.0 AS seconds", "true AS saved")
    tables.write_epoch_rows(epochs, str(tmp_path))
    assert len([p for p in os.listdir(tmp_path / "epochs") if "=" in p]) < 100
    tables.write_epochs(spark, [{"epoch": 7, "loss_train": 9, "loss_valid": 9, "seconds": 9, "saved": False}], str(tmp_path), "3")
    got = {}
    for r in tables.read_epochs(spark, str(tmp_path)).collect():
        got.setdefault(r.run_id, []).append((r.epoch, r.loss_train, r.saved))
    assert got.pop("3") == [(7, 9.0, False)]
    assert len(got) == 499 and all(sorted(v) == [(i, 1.0, True) for i in range(3)] for v in got.values())


def test_many_outcars_to_a_file(spark, tmp_path):
    """Runs need no folder each; they come back whole where a file is cut, whichever of them begins in a piece of it."""
    rows = [(g, i, f"run {g}", [[10.0 + i, 0.0, 0.0], [0.0, 11.0, 0.0], [0.0, 0.0, 12.0]], ["Fe", "Co"], [[g + j / 8, 0.5, -1.0] for j in range(2)], [[0.0, j / 4, -0.5] for j in range(2)], -5.0 - i, -5.5 - i) for g in range(200) for i in range(1 + g % 4)]
    df = spark.createDataFrame(rows, "structure_id long, step int, comment string, cell array<array<double>>, symbols array<string>, positions array<array<double>>, forces array<array<double>>, energy double, free_energy double")
    structures.write_outcar_runs(structures.outcar_text(df), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.txt"))) < 20
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {(r.comment, r.step): r for r in structures.read_outcar_runs(spark, str(tmp_path / "out/*.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    for _, step, comment, cell, symbols, positions, forces, energy, free in rows:
        r = got[comment, step]
        assert (r.cell, r.symbols, r.positions, r.forces, r.energy, r.free_energy) == (cell, symbols, positions, forces, energy, free)
