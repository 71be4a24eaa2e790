import os

from nodeloom import storage
from nodeloom.llm import common


def test_what_is_stored_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(storage, "_written", [])
    df = common.stored(spark.range(5), "some")
    (path,) = storage._written
    local = path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(local)
    common.clear(spark)
    assert not os.path.exists(local) and storage._written == []


def test_what_is_stored_can_be_forgotten(spark):
    df, other = common.stored(spark.range(5), "some"), common.stored(spark.range(3), "some")
    common.forget(df)
    assert not os.path.exists(df.stored_at.removeprefix("file:")) and other.count() == 3
    assert df.stored_at not in storage._written and other.stored_at in storage._written


def test_fresh_names():
    assert common.fresh(["A", "a_", "x"], "a", "x", "b", "B") == ["a__", "x_", "b", "B_"]


def test_heavy_rows_are_few(spark):
    counts = spark.createDataFrame([(i, 10_000 * (i == 0) + 4096 + i % 2) for i in range(50)], "k int, n long")
    rows, bound = common.heavy(counts, "n", 200_000)
    assert bound == 200_000 // 16 and [r.k for r in rows.collect()] == [0]
    rows, bound = common.heavy(counts, "n", 10)
    assert bound == 4096 and rows.count() == 26
