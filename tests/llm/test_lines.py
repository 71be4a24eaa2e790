import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nodeloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("abé", max_size=14), st.text("abé", max_size=14), st.integers(0, 4))
def test_band(a, b, t):
    assert lines.within(a, b, t) == (distance(a, b) <= t)


def edited(draw, line, n):
    line = list(line)
    for _ in range(n):
        at, what = draw.randrange(len(line)), draw.randrange(3)
        line[at : at + (what > 0)] = [] if what == 1 else [draw.choice("abcé🙂")]
    return "".join(line)


def close(x, y, t):
    """Whether the edit distance is t at most, by its definition on what differs between the ends that both share."""
    if abs(len(x) - len(y)) > t:
        return False
    n = min(len(x), len(y))
    head = next((i for i in range(n) if x[i] != y[i]), n)
    tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) > 400 or len(y) > 400:
        raise AssertionError("too long for the plain way")
    return distance(x, y) <= t


def corpus(seed):
    draw = random.Random(seed)
    make = lambda n: "".join(draw.choice("abcdefghij lmno éß🙂") for _ in range(n))
    base = [make(draw.choice((5, 31, 32, 33, 60, 95, 96, 97, 98, 200))) for _ in range(40)]
    rows = []
    for i in range(60):
        own = [edited(draw, draw.choice(base), draw.choice((0, 1, 1, 2, 2, 3))) if draw.random() < 0.7 else make(draw.randrange(1, 120)) for _ in range(draw.randrange(1, 8))]
        rows.append((i * 2, "\n".join(own + [""] * draw.randrange(2))))
    return rows + [(1, None), (3, ""), (5, "\n\n"), (None, rows[0][1]), rows[4], (900, rows[4][1]), (901, "x" * 70_000), (902, "x" * 69_999), (903, "x" * 69_996), (904, "x" * 35_000 + "y" + "x" * 35_000), (8, "other text under this id")]


def brute(rows, edits=lines.EDITS):
    seen = sorted({(d, i, x) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.split("\n")) if x.strip()})
    out = []
    for d, t in rows:
        if t is None or d is None:
            out.append((d, t, 0))
            continue
        kept = []
        for i, x in enumerate(t.split("\n")):
            earlier = (y for e, j, y in seen if (e, j) < (d, i))
            near = x.strip() and any(x == y or close(x, y, lines.allowed(min(len(x), len(y)), edits)) for y in earlier)
            if not near:
                kept.append(x)
        out.append((d, "\n".join(kept), len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("id", "x"), ("gone", 1), ("of", 2), ("Tag", "mine"), ("__id", "mine"), ("n_lines", "old"), ("key", 3)):
        docs = docs.withColumn(name, F.lit(value))
    for edits, group in ((lines.EDITS, lines.GROUP), (((20, 1), (40, 2), (90, 3)), 4), (((50, 2),), 2)):
        got = lines.deduplicate_lines(docs.repartition(4), edits, group=group)
        assert got.columns == ["doc_id", "text", "id", "gone", "of", "Tag", "__id", "key", "n_lines", "n_removed"]
        found = got.collect()
        assert sorted(((r.doc_id, r.text, r.n_removed) for r in found), key=str) == brute(rows, edits)
        assert {(r.id, r.gone, r.of, r.Tag, r["__id"], r.key) for r in found} == {("x", 1, 2, "mine", "mine", 3)}


def test_edits_are_checked():
    for bad in ((), ((32, 0),), ((2, 2),), ((32, 2), (64, 1))):
        with pytest.raises(ValueError):
            lines.checked(bad)


def test_many_lines_that_share_a_segment(spark):
    """A frequent phrase in lines that are otherwise different, and in numbered ones that are near: blocks, not pairs."""
    draw = random.Random(1)
    name = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, f"This page is brought to you by the friends of {name(24)} and all the others who helped") for i in range(3000)]
    rows += [(5000 + i, f"Page {i:05d} of the printed edition, all rights are reserved by the house") for i in range(0, 1500)]
    draw.shuffle(rows)
    cut = lines.Cut([t for _, t in rows])
    pairs, keys, _, sizes = lines.met(*lines.entries(cut, np.arange(len(rows))), 2)
    assert len(pairs) < 20 * len(rows) and sizes.max() >= 1000
    found = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = lines.repeated_lines(found.withColumn("tag", F.xxhash64("text")), block_chars=1 << 15)
    got = {r.of for r in gone.collect()}
    assert got == set(range(5001, 6500))  # another digit makes any number an earlier one; names are too far apart


def test_empty(spark):
    assert lines.deduplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_part_hashes():
    found = lines.Cut(["abcab", "", "xx\nab"])
    assert found.text.tolist() == [0, 1, 2, 2] and found.number.tolist() == [0, 0, 0, 1]
    one = found.part(np.array([0, 0, 3]), np.array([0, 3, 0]), 2)
    assert one[0] == one[1] == one[2] != found.part(np.array([0]), 1, 2)[0]


def test_pieces_of_long_texts():
    draw = random.Random(3)
    texts = ["\n".join("x" * draw.randrange(12) for _ in range(draw.randrange(1, 40))) for _ in range(30)] + ["", "\n", "y" * 100, "\n\n" + "z" * 70 + "\n"]
    want = [(t, n, len(x)) for t, text in enumerate(texts) for n, x in enumerate(text.split("\n"))]
    whole = lines.Cut(texts)
    for most in (1, 7, 50, 10_000):
        parts = list(lines.cuts(texts, most))
        assert [x for p in parts for x in zip(p.text.tolist(), p.number.tolist(), p.length.tolist())] == want
        assert np.concatenate([p.id for p in parts]).tolist() == whole.id.tolist() and np.concatenate([p.check() for p in parts]).tolist() == whole.check().tolist()
        assert np.concatenate([p.blank for p in parts]).tolist() == whole.blank.tolist() and np.concatenate([p.parity for p in parts]).tolist() == whole.parity.tolist()
    assert list(lines.cuts([])) == []
