import random

import numpy as np
from pyspark.sql import functions as F

from nodeloom.llm import minmax


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """Components by comparing every pair."""
    rows = [r for r in rows if r[0] is not None]
    sets, parent = [shingles(t, k) for _, t in rows], {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in parent}


def corpus(seed, n_groups=25, members=8):
    draw = random.Random(seed)
    vocabulary = [f"Wé{i}" for i in range(3000)]
    rows = []
    for _ in range(n_groups):
        base = draw.choices(vocabulary, k=draw.choice((12, 40, 120)))
        for _ in range(members):
            copy = list(base)
            for _ in range(draw.choice((0, 0, 1, 2, 4, 8))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(" ".join(copy))
    draw.shuffle(rows)
    rows = [(3 * i + 5, t) for i, t in enumerate(rows)]
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "one"), (7, "ONE"), rows[0], (None, rows[1][1]), (10**12, "a\tB c"), (10**12 + 1, "A b\nC")]


def test_against_all_pairs(spark):
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(3)
    for k in (2, 5):
        want = brute(rows, k)
        got = minmax.near_duplicates(docs, words=k).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_blocks_lose_nothing(spark):
    rows = [r for r in corpus(2, 2, 150) if r[0] is not None and (r[1] or "").split()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("node")).distinct()
    sets = minmax.shingles_of(docs, nodes, 2)
    want = brute(rows, 2)
    for half in (False, True):  # nothing known yet, and half of the documents joined already
        known = {d: want[d] if half and d % 2 else d for d in want}
        left = spark.createDataFrame([(5, d, known[d], len(want)) for d in want], "key long, node long, comp long, n long")
        links = [tuple(r) for r in minmax.block_links(left, sets, 80, block=32).collect()] + list(known.items())
        parent = {d: d for d in want}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            x, y = root(u), root(v)
            parent[max(x, y)] = min(x, y)
        assert {d: root(d) for d in want} == want


def chain(n, length=60, moved=8):
    """Texts of which neighbors are alike by a little less than a link, and every tenth is a near copy of the one before."""
    words = [f"c{i}" for i in range(n * moved + length)]
    rows = []
    for i in range(n):
        own = words[i * moved : i * moved + length]
        rows.append((10 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((10 * i + 1, " ".join(own[:-1] + ["changed"])))
    return rows


def test_a_chain_of_weakly_similar_texts_is_no_family(spark):
    rows = chain(400)
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == {d: d - d % 10 for d, _ in rows}
    classes = minmax.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 2).select(F.col("doc_id").alias("node"), "bands")
    members = minmax.members_of(classes).cache()
    assert members.where("node <> hub").select("node").distinct().count() > 200  # the chain is there
    joined = spark.createDataFrame([], "node long, component long")
    assert minmax.open_buckets(members, joined).agg(F.max("n")).first()[0] <= 12  # and nothing follows it


def test_hub_of_many(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"x{i}"] + base[100:])) for i in range(300)] + [(1000, " ".join(draw.choices(base, k=200)))]
    monkeypatch.setattr(minmax, "heavy", lambda counts, n, total, least: (counts.where(F.col(n) > 20), 20))
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == {d: 0 if d < 1000 else d for d, _ in rows}


def test_very_long_text(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, words), (2, words + " tail"), (3, words.upper()), (4, "w1 w2 w3")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (59_996, 1), 2: (59_997, 1), 3: (59_996, 1), 4: (1, 4)}


def test_values_agree_as_similarity():
    draw = np.random.default_rng(4)
    pool = draw.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:1200])
    same = np.mean([x == y for x, y in zip(*minmax.signatures([a, b], 2000))])
    assert abs(same - 800 / 1200) < 0.03


def test_empty(spark):
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_count():
    a, b = np.array([1, 3, 9], np.uint64), np.array([3, 4, 9, 10], np.uint64)
    assert minmax.common_count(a, b) == minmax.common_count(b, a) == 2 and minmax.common_count(a, b[:0]) == 0
    assert minmax.linked(a, a, 100) and not minmax.linked(a, b, 80)
