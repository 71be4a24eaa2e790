from pyspark.sql import functions as F

from nodeloom.llm import mixing


def test_rest_that_rounds_up_to_a_whole_turn(spark):
    rows = [(1, "a", "one"), (2, "b", "word " * 100), (3, "b", "word " * 200), (4, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for weights, share, most, turns in (((1, 1, 1), 1.0, 0.9987, 1), ((1, 1, 1), 2.0, 1.9987, 2)):
        got = {r.doc_id: r for r in mixing.mix(docs, weights, share, most).collect()}
        assert {i: r.taken for i, r in got.items()} == {1: turns, 2: 100 * turns, 3: 200 * turns, 4: 0}
        assert abs(got[2].target - 300 * most) < 1e-9
        kept = mixing.apply_mix(docs, weights, share, most).groupBy("doc_id").agg(F.count("*")).collect()
        assert {tuple(r) for r in kept} == {(i, turns) for i in (1, 2, 3)}
