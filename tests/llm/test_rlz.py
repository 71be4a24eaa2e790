import random

from pyspark.sql import functions as F

from nodeloom.llm import rlz


def brute(rows, span=13):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - span + 1):
                key = tuple(w[i : i + span])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - span + 1):
            if d is not None and first[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"é{i}" for i in range(60)] + ["the", "of"] * 30
    passages = [draw.choices(vocabulary, k=draw.choice((12, 13, 14, 40, 70))) for _ in range(8)]
    rows = []
    for i in range(120):
        w = draw.choices(vocabulary, k=draw.randrange(0, 120))
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(w) + 1)
            w[at:at] = draw.choice(passages)
        rows.append((i * 3, " \n".join(w)))
    rows += [(500, rows[7][1]), (501, "same " * 200), (502, "same " * 60), (503, None), (504, ""), (None, rows[9][1]), (12, rows[4][1]), (15, rows[80][1] + " tail"), (9, rows[3][1])]
    return rows


def test_against_brute_force(spark):
    for seed, block in ((1, 10**6), (2, 300), (3, 1)):
        rows = corpus(seed)
        texts = {}
        for d, t in rows:
            texts.setdefault(d, []).append((t or "").split())
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("x")).withColumn("Block", F.lit("x")).repartition(4)
        got = rlz.deduplicate(docs, block_words=block).collect()
        assert sorted((tuple(r[:4]) for r in got), key=str) == brute(rows)
        for r in got:
            covered = set()
            for f in r.factors:
                assert f.n_words >= 13 and f.ref < r.doc_id
                assert any(w[f.start : f.start + f.n_words] == v[f.ref_start : f.ref_start + f.n_words] for w in texts[r.doc_id] for v in texts[f.ref])
                covered |= set(range(f.start, f.start + f.n_words))
            assert len(covered) == r.n_removed == sum(s.n_words for s in r.spans)
            assert covered == {i for s in r.spans for i in range(s.start, s.start + s.n_words)}
            assert all(a.start + a.n_words < b.start for a, b in zip(r.spans, r.spans[1:]))


def naive_parse(rows, span=13):
    """Greedy factors by definition: the reference is the first place of each phrase that a later document repeats, put together where they overlap; every longest match is looked for in all of it."""
    words = sorted((d, t.encode().split()) for d, t in rows)
    homes, again = {}, set()
    for d, w in words:
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            if key not in homes:
                homes[key] = (d, i)
            elif homes[key][0] < d:
                again.add(key)
    places, fragments = sorted(homes[k] for k in again), []
    for d, i in places:
        if fragments and fragments[-1][0] == d and i <= fragments[-1][2]:
            fragments[-1][2] = i + span
        else:
            fragments.append([d, i, i + span])
    of, out = dict(words), {}
    for d, w in words:
        at, out[d] = 0, []
        while at <= len(w) - span:
            best = (0, 0, 0)
            for r, a, b in fragments:
                if r < d:
                    for p in range(a, b):
                        n = 0
                        while at + n < len(w) and p + n < b and of[r][p + n] == w[at + n]:
                            n += 1
                        if n > best[0]:
                            best = (n, r, p)
            if best[0] >= span:
                out[d].append((at, *best))
                at += best[0] - span + 1
            else:
                at += 1
    return out


def test_factors_equal_a_naive_greedy_parse(spark):
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [draw.choices(vocabulary, k=n) for n in (13, 20, 45, 60)]
    rows = []
    for i in range(40):
        w = draw.choices(vocabulary, k=draw.randrange(0, 40))
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            a = draw.randrange(len(p) - 12)
            at = draw.randrange(len(w) + 1)
            w[at:at] = p[a : a + draw.randrange(13, len(p) + 1)]
        rows.append((i, " ".join(w)))
    rows += [(50, "so " * 40), (51, "so " * 30), (52, rows[3][1] + " " + rows[4][1])]
    want = naive_parse(rows)
    got = rlz.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: [tuple(f) for f in r.factors] and sorted((f.start, f.n_words, f.ref, f.ref_start) for f in r.factors) for r in got} == want
    assert sum(map(len, want.values())) > 40


def test_long_texts_and_a_hot_block(spark, monkeypatch):
    """A document of 200,000 words that all others repeat parts of: its block is copied, and shared."""
    draw = random.Random(3)
    words = [f"v{draw.randrange(5000)}" for _ in range(200_000)]
    rows = [(0, " ".join(words))] + [(i, f"own{i} " + " ".join(words[100 * i : 100 * i + 40]) + f" tail{i}") for i in range(1, 300)]
    monkeypatch.setattr(rlz, "heavy", lambda counts, n, total: (counts.where(F.col(n) > 50), 50))
    got = {r.doc_id: r for r in rlz.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 40 and got[i].kept_text == f"own{i} tail{i}" for i in range(1, 300))


def test_empty(spark):
    assert rlz.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors():
    draw = __import__("numpy").random.default_rng(0)
    hashes = draw.integers(0, 9, 300).astype("uint64")
    grams, best = rlz.anchors(hashes, 13, 4)
    assert len(grams) == 297 and best.tolist() == [i + int(grams[i : i + 10].argmin()) for i in range(288)]
