"""Order statistics without sorting, against sorting."""

import math
import os
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import readout, sampling, selection, training_windows
from nodeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_value_order(spark):
    draw = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.7976931348623157e308, 0.1, 1 / 3, *(2.0**e for e in range(-1070, 1023, 7))]
    values += [math.nextafter(v, d) for v in values if v and math.isfinite(v) for d in (0, math.inf) if math.isfinite(math.nextafter(v, d))]
    values += [struct.unpack("d", draw.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    got = {r.v: r.o for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.value_order(F.col("v")).alias("o")).collect()}
    for v, o in got.items():
        bits = struct.unpack("q", struct.pack("d", abs(v)))[0]
        assert o == (-bits if v < 0 else bits)
    last = spark.createDataFrame([(math.nan,), (None,)], "v double").select(selection.value_order(F.col("v")).alias("o")).collect()
    assert last[0].o > max(got.values()) and last[1].o is None


def rows_of(seed, n=4000):
    """Most rows have one key; values repeat, some are missing."""
    draw = random.Random(seed)
    return [(i, None if draw.random() < 0.02 else "hot" if draw.random() < 0.9 else draw.choice("ab"), draw.choice([None, 1.5, -2.0, draw.uniform(-5, 5), draw.gauss(0, 1e6)])) for i in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.37, 1.0])
def test_chosen(spark, share):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(5)
    got = selection.chosen(df, [selection.value_order(F.col("v")), *selection.draw_orders("id", 2)], lambda n: F.floor(n * share), ("k",), "hit").collect()
    assert len(got) == len(rows)
    for k in {r[1] for r in rows}:
        own = [r for r in got if r.k == k]
        full = sorted(r.v for r in own if r.v is not None)
        n = math.floor(len(full) * share)
        assert sorted(r.v for r in own if r.hit) == full[:n]


def test_equal_rows_and_nothing(spark):
    df = spark.createDataFrame([("x", 1.0)] * 500 + [("y", 2.0)] * 3 + [(None, None)] * 4, "id string, v double")
    got = selection.chosen(df, selection.draw_orders("id", 0), lambda n: F.lit(123), steps=selection.DRAW_STEPS).where("chosen").collect()
    assert len(got) == 123
    assert selection.chosen(df, [selection.value_order(F.col("v"))], lambda n: F.lit(9)).where("chosen").select("v").distinct().collect() == [(1.0,)]
    for n in (0, 10_000):
        assert selection.chosen(df, [selection.value_order(F.col("v"))], lambda _: F.lit(n)).where("chosen").count() == min(n, 503)
    assert selection.chosen(df.limit(0), [selection.value_order(F.col("v"))], lambda n: n).count() == 0
    assert selection.chosen(df.limit(0), [selection.value_order(F.col("v"))], lambda n: n, ("id",)).count() == 0


def test_means_of_shares(spark):
    rows = rows_of(8)
    df = spark.createDataFrame(rows, "id long, k string, v double")
    low = {r.k: r.low_mean for r in readout.lowest_share_mean(df, ("k",), "v", 0.25).collect()}
    loss = {r.k: r.loss for r in training_windows.worst_share_loss(df.withColumn("p", F.lit(0.5)), 0.1, ("k",), "p", "v").collect()}
    for k in {r[1] for r in rows}:
        full = sorted(v for _, key, v in rows if key == k and v is not None)
        n = len(full) // 4
        assert low[k] == pytest.approx(sum(full[:n]) / n)
        worst = [(v - 0.5) ** 2 for v in full[::-1][: math.ceil(len(full) * 0.1)]]
        assert loss[k] == pytest.approx(sum(worst) / len(worst))
    few = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0)], "id long, k string, v double")
    assert readout.lowest_share_mean(few, ("k",), "v").first().low_mean is None


def test_draws_as_sorted(spark):
    import hashlib

    df = spark.range(3000).withColumn("cluster", F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99))
    got = sampling.by_quota(df, 0.2, 5)
    order = lambda seed: lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    kinds = {}
    for i in range(3000):
        kinds.setdefault(i % 7 if i % 10 == 0 else 99, []).append(i)
    quota = math.ceil(600 / len(kinds))
    first = {i for ids in kinds.values() for i in sorted(ids, key=order(5))[:quota]}
    rest = sorted(set(range(3000)) - first, key=order(6))[: 600 - len(first)]
    assert {r.id for r in got.where("sampled").collect()} == first | set(rest)


def windows_over(plan: str) -> list[str]:
    """For every Window of a plan the first operator below it that isn't one of columns, filters or order."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-")) for x in plan.splitlines() if x.strip()]
    out = []
    for i, (_, name) in enumerate(lines):
        if re.match("Window ", name):
            out.append(next(n.split()[0] for _, n in lines[i + 1 :] if not re.match("Project|Filter|Sort|Window|Repartition", n)))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["low_quartile_mean", "max_n_percent_loss", "extreme_rows", "sample_random", "sample_property_bin", "sample_grid", "sample_subgraph", "three_way_split"])
def test_nothing_is_ranked(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert set(windows_over(plan)) <= {"Aggregate"}


def test_steps_know_their_size(spark):
    """A step's thresholds come from a file, so that the next one's join needs no shuffle of the rows."""
    rows = spark.range(5000).selectExpr("id % 3 AS k", "cast((id * 7919) % 4999 AS double) AS v")
    ends = selection.thresholds(rows, selection.value_order(F.col("v")), lambda n: F.floor(n * 0.25), ("k",), F.col("v"))
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Scan parquet") == 1
    kept = sorted((r.k, r["__sel_below"] + r["__sel_rest"]) for r in ends.collect())
    assert kept == sorted((k, len(range(k, 5000, 3)) // 4) for k in range(3))


def test_an_order_is_computed_once(spark):
    """However often it names the logarithm of a value, and what step reads it."""
    plan = spark.range(3).select(selection.value_order(F.col("id").cast("double")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("LOG2") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_shares_are_dealt_out_by_graph(spark):
    """Edges, their species and angles meet where the atoms of a graph already are: nothing is dealt out by node or edge."""
    import re

    plan = catalogue.ratio_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"gid#\d+L(, dim#\d+)?", x) for x in dealt)
