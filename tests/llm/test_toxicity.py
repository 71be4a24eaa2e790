import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from nodeloom.llm import toxicity as tox


def corpus(n=1500, seed=3):
    draw = random.Random(seed)
    plain = ["".join(draw.choices("abdeghilmnorst", k=draw.randrange(3, 9))) for _ in range(400)]
    bad = [["grob" + s for s in ("e", "ian", "heit", "ling", "zeug")], ["vile"], ["scuzz"], ["blarg"]]
    rows = []
    for i in range(n):
        toxic = draw.random() < 0.15
        words = draw.choices(plain, k=draw.randrange(5, 80))
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(draw.choice(bad)))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "vile"), (5000, None), (5001, ""), (3, rows[3][1])], "doc_id long, text string").withColumn("hits", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2] + [(None, 1), (4, None), (5, 0)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    assert {"vile", "scuzz", "blarg", "grob*"} <= set(model.lexicon)
    out = tox.scored(docs, model).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    truth = {d: t for d, _, t in rows}
    held = [r for r in out if r.doc_id is not None and r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(r.score < 0.5 for r in out if r.doc_id in (5000, 5001))
    changed = spark.createDataFrame([(r[0], r[2] if zlib.crc32(str(r[0]).encode()) % 5 else 1 - r[2]) for r in rows if r[0] % 2], "doc_id long, toxic int")
    assert tox.fit(docs, changed).lexicon == model.lexicon  # held-out labels are not looked at


def test_label_model():
    draw = np.random.default_rng(1)
    n, y = 40_000, None
    y = draw.random(n) < 0.2
    right = np.array([0.9, 0.8, 0.7, 0.85, 0.75, 0.6])
    bits = np.zeros((n, tox.VOTERS), np.int64)
    bits[:, :6] = (draw.random((n, 6)) < np.where(y[:, None], right, 0.02))
    bits[:, 6] = np.where(draw.random(n) < 0.02, 1 - bits[:, 0], bits[:, 0])  # repeats another
    patterns, counts = np.unique((bits << np.arange(tox.VOTERS)).sum(1), return_counts=True)
    posterior, rate, correlations = tox.label_model(patterns, counts.astype(float), 0.2)
    assert np.abs(rate[1][:6] - right).max() < 0.05
    assert correlations[1][0, 6] > 2 and np.count_nonzero(np.triu(correlations[1])) <= 3  # the pair has a term, few others do
    guess = dict(zip(patterns.tolist(), posterior))
    assert np.mean([(guess[p] > 0.5) == t for p, t in zip((bits << np.arange(tox.VOTERS)).sum(1).tolist(), y)]) > 0.97


def test_terms_fit_a_table_exactly():
    """All single and pair terms of three voters against a known distribution over their patterns."""
    draw = np.random.default_rng(4)
    every = (np.arange(8)[:, None] >> np.arange(3)) & 1
    pairs = np.array([(0, 1), (0, 2), (1, 2)])
    features = np.hstack([every, every[:, pairs[:, 0]] * every[:, pairs[:, 1]]]).astype(float)
    want = draw.normal(0, 1, 6)
    p = np.exp(features @ want)
    p /= p.sum()
    got, log = tox.fitted_terms(p @ features, features, np.zeros(6), decay=0.0, steps=50)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(np.exp(log), p, atol=1e-6)


def test_votes():
    model = tox.Model(["blarg", "grob*", "vile"], frequent=frozenset({"vile"}))
    name = lambda text: {tox.VOTER_NAMES[j] for j in range(tox.VOTERS) if model.votes(text)[0] >> j & 1}
    assert name("all is well") == {"none"} and name("") == {"none"}
    assert name("x " * 100 + "vile") == {"frequent word"} and name("x " * 200 + "blarg " + "vile") == {"frequent word", "rare word", "two roots"}
    assert name("YOU ARE GROBIAN") == {"beginning of 4", "addressed", "dense", "address", "loud"}
    assert name("you " + "x " * 100 + "vile") == {"frequent word", "address"}


def test_very_long_text(spark):
    model = tox.Model(["vile"], np.array([4.0]))
    docs = spark.createDataFrame([(1, "calm " * 400_000 + "vile"), (2, "calm " * 400_000)], "doc_id long, text string")
    assert [r.score > 0.5 for r in tox.scored(docs, model).orderBy("doc_id").collect()] == [True, False]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.scored(docs, tox.fit(docs, none)).first().score < 0.5
    assert tox.scored(docs.limit(0), tox.fit(docs.limit(0), none)).count() == 0


def test_held_out_fold_of_the_tables(spark):
    """Precision, recall and the area under the curve where the driver's labels were held out."""
    import os

    import pytest

    from nodeloom.llm import queries

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no tables")
    scores = queries.op4_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").where("toxic IS NOT NULL").collect()
    good, bad = sorted(r.score for r in scores if r.toxic == 0), sorted(r.score for r in scores if r.toxic == 1)
    area = sum(np.searchsorted(good, s, "left") + np.searchsorted(good, s, "right") for s in bad) / 2 / len(good) / len(bad)
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in scores)
    assert area >= 0.95 and hits / len(bad) >= 0.75 and hits / sum(r.predicted for r in scores) >= 0.97
