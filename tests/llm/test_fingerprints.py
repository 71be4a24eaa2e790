import hashlib
import random

from pyspark.sql import functions as F

from nodeloom.llm import fingerprints as fp


def shingles(text, k=5):
    w = text.replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_study_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = [(i * 7, " ".join(draw.choices(vocabulary, k=draw.choice((1, 4, 5, 30, 200, 900))))) for i in range(60)]
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (1003, " \n\t "), (None, "last one"), (5, "x" * 30_000), (12, "a b c d e f"), (12, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("values", F.lit(1)).repartition(5)
    got = fp.edit_study(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [t or "" for _, t in ordered]
    want = {}
    for i, (d, _) in enumerate(ordered):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        want.setdefault(d, []).append((t, e, jaccard(shingles(t), shingles(e)), jaccard(shingles(t), shingles(n))))
    prints = {}
    for r in got:
        t, e, near, after = want[r.doc_id][-1 if r.near_next < 1 else 0] if r.doc_id == 12 else want[r.doc_id][0]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - near) < 0.2 and abs(r.near_next - after) < 0.2, (t, e, near, r)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == (fp.BINS * fp.BITS // 4 if t.split() else 0)
    assert len(set(prints.values())) >= len({t for t in prints if t.split()})
    errors = [r.near_edited - want[r.doc_id][0][2] for r in got if r.doc_id != 12]
    assert abs(sum(errors) / len(errors)) < 0.03  # unbiased


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    row = fp.edit_study(docs).first()
    assert row.near_next == 1.0
    assert fp.edit_study(docs.limit(0)).count() == 0


def plain(text, bins=fp.BINS, bits=fp.BITS, k=fp.WORDS):
    """Bins, draws for the empty ones and packed bits, written out with loops."""
    import re

    import xxhash

    def mix(seed, value):
        data = value if isinstance(value, bytes) else value.to_bytes(8 if value >= 1 << 31 or value < -(1 << 31) else 4, "little", signed=True)
        return xxhash.xxh64_intdigest(data, seed)

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def long(value):
        return (value & (1 << 64) - 1).to_bytes(8, "little")

    words = [signed(mix(42, w.encode())) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return []
    found = []
    if len(words) < k:
        h = 0
        for w in words:  # each step takes the value so far and the word
            h = signed(xxhash.xxh64_intdigest(long(w), xxhash.xxh64_intdigest(long(h), 42)))
        found = [h & (1 << 63) - 1]
    else:
        for i in range(len(words) - k + 1):
            h = 42
            for w in words[i : i + k]:
                h = xxhash.xxh64_intdigest(long(w), h)
            found.append(h & (1 << 63) - 1)
    shift = 63 - (bins.bit_length() - 1)
    least = {}
    for h in sorted(found, reverse=True):
        least[h >> shift] = h
    filled = [least[b] for b in sorted(least)]
    out = []
    for b in range(bins):
        if b not in least:
            chances = [(signed(mix(mix(42, b), x >> shift)) & -bins) | i for i, x in enumerate(filled)]
            out.append(filled[max(chances) & (bins - 1)] & (1 << bits) - 1)
        else:
            out.append(least[b] & (1 << bits) - 1)
    return out


def test_bit_by_bit(spark):
    draw = random.Random(11)
    texts = [None, "", " \t", "one", "a b c d", "a b c d e", "é 漢 🙂 x y z", *(" ".join(draw.choices(["w%d" % i for i in range(90)], k=n)) for n in (6, 20, 130, 700, 3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fp.fingerprints(rows).collect():
        want = plain(texts[r.doc_id])
        assert r["values"] == want and r.fingerprint == "".join(f"{v:02x}" for v in want)


def test_very_long_text(spark):
    text = " ".join("w%d" % (i * i % 9973) for i in range(150_000))
    assert fp.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["values"] == plain(text)
