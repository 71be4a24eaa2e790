import numpy as np
from pyspark.sql import functions as F

from nodeloom.llm import chroma


def melody(draw, notes, seconds=0.25):
    return chroma.sonify(list(draw.normal(0, 0.15, notes)), seconds)


def test_wav_round_trip():
    x = np.sin(np.arange(5000) / 20)
    got, rate = chroma.decode_wav(chroma.encode_wav(x, 8000))
    assert rate == 8000 and np.abs(got - x).max() < 1e-3
    for bad in (None, b"", b"RIFF", b"x" * 100, chroma.encode_wav(x)[:30]):
        assert len(chroma.fingerprint(bad)) == 0


def test_pitch_class_of_a_tone():
    tone = np.sin(2 * np.pi * 440 * np.arange(3 * 11025) / 11025)
    assert (chroma.pitch_classes(tone, 11025).argmax(1) == 0).all()
    octave = np.sin(2 * np.pi * 880 * np.arange(3 * 22050) / 22050)
    assert (chroma.pitch_classes(octave, 22050).argmax(1) == 0).all()


def best_error(a, b):
    """Lowest bit error over all offsets with some overlap, one by one."""
    found = []
    for d in range(-len(b) + 8, len(a) - 7):
        x, y = (a[d:], b) if d >= 0 else (a, b[-d:])
        n = min(len(x), len(y))
        found.append((np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n), d))
    return min(found)


def test_search_against_all_offsets(spark):
    draw = np.random.default_rng(5)
    whole = [chroma.decode_wav(melody(draw, 60))[0] for _ in range(6)]
    rows = [(i, chroma.encode_wav(x)) for i, x in enumerate(whole)]
    rows += [(10 + i, chroma.encode_wav(x[40 * chroma.HOP :])) for i, x in enumerate(whole)]  # cut
    rows += [(20 + i, chroma.encode_wav(0.5 * x + draw.normal(0, 0.01, len(x)))) for i, x in enumerate(whole)]  # softer, with noise
    rows += [(30, rows[0][1]), (31, None), (32, b"no sound"), (None, rows[1][1])]
    clips = spark.createDataFrame(rows, "clip_id long, audio binary").withColumn("frames", F.lit("x"))
    got = {r.clip_id: r for r in chroma.matched(clips, lambda i: i < 6).collect()}
    assert len(got) == len(rows)
    prints = {i: chroma.fingerprint(a) for i, a in rows if i is not None}
    for i in range(6):
        for kind in (10, 20):
            r = got[kind + i]
            assert r.n_links >= 1 and r.best_query == i
            error, d = best_error(prints[kind + i], prints[i])
            assert r.offset == d and abs(r.bit_error - error) < 1e-9
        assert got[10 + i].offset == -40
    assert got[30].class_id == 0 and got[31].n_links == got[32].n_links == 0 and got[None].n_links == 0
    blocks = chroma.search(chroma.fingerprints(clips).where("clip_id < 30"), chroma.fingerprints(clips).where("clip_id < 6"), block=2)
    one = chroma.search(chroma.fingerprints(clips).where("clip_id < 30"), chroma.fingerprints(clips).where("clip_id < 6"))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, one.collect()))


def test_empty(spark):
    assert chroma.matched(spark.createDataFrame([], "clip_id long, audio binary"), lambda i: i < 6).count() == 0


def test_recall_against_all_offsets(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(0, 0.125, (60, 64))
    near = vectors + draw.normal(0, 1, vectors.shape) * np.repeat((0.005, 0.009, 0.012), 20)[:, None]
    asks, held = ([chroma.fingerprint(chroma.sonify(list(v), 0.125)) for v in x] for x in (vectors, near))
    held += [f[cut:] for f, cut in zip(held[:20], range(5, 25))] + [held[40][:2], held[41][:7]]
    rows = lambda x: spark.createDataFrame([(i, f.view(np.int32).tolist()) for i, f in enumerate(x)], "clip_id long, frames array<int>")
    got = {(r.query_id, r.clip_id): r for r in chroma.search(rows(held), rows(asks)).collect()}
    want = {}
    for q, b in enumerate(asks):
        for c, a in enumerate(held):
            for d in range(3 - len(b), len(a) - 2):
                x, y = (a[d:], b) if d >= 0 else (a, b[-d:])
                n = min(len(x), len(y))
                error = np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)
                if n >= 3 and error <= chroma.MOST_ERROR:
                    want.setdefault((q, c), {})[d] = (n, error)
    for long in (3, 8, 24):  # frames of overlap
        pairs = {p for p, at in want.items() if max(n for n, _ in at.values()) >= long}
        hard = {p for p in pairs if min(e for _, e in want[p].values()) >= 0.15}
        assert len(hard) > 10 and len(pairs & got.keys()) >= 0.9 * len(pairs) and len(hard & got.keys()) >= 0.9 * len(hard)
    assert all(want[p][r.offset] == (r.overlap, r.bit_error) for p, r in got.items())
    summed = {r.clip_id: r for r in chroma.search(rows(held), rows(asks), summed=True).collect()}
    for c in range(len(held)):
        links = [(r.bit_error, r.query_id, r.offset) for (q, k), r in got.items() if k == c != q]
        assert (summed[c].n_links, (summed[c].bit_error, summed[c].query_id, summed[c].offset)) == (len(links), min(links)) if links else c not in summed


def test_filters_as_loops_over_rectangles():
    """Each filter's two sums, frame by frame and class by class, without an integral image."""
    draw = np.random.default_rng(8)
    image = np.abs(draw.normal(size=(40, 12)))
    image /= np.sqrt((image**2).sum(1, keepdims=True))
    got = chroma.pack(image)
    assert len(got) == len(image) - chroma.WIDEST + 1
    for t, value in enumerate(got.tolist()):
        for j, (kind, y, h, w) in enumerate(chroma.FILTERS):
            one = other = 0.0
            for f in range(w):
                for c in range(12):
                    x, inside = image[t + f, c], y <= c < y + h
                    early, low = f < w // 2, c < y + h // 2
                    if kind == 0:
                        one, other = (one + x / h, other) if inside else (one, other + x / max(12 - h, 1))
                    elif inside:
                        first = {1: low, 2: early, 3: early == low, 4: w // 4 <= f < w - w // 4}[kind]
                        one, other = (one + x, other) if first else (one, other + x)
            response = np.log((1 + one) / (1 + other))
            level = int(response > -chroma.STEP) + int(response > 0) + int(response > chroma.STEP)
            near = min(abs(response - v) for v in (-chroma.STEP, 0.0, chroma.STEP)) < 1e-9
            assert near or value >> 2 * (15 - j) & 3 == (0, 1, 3, 2)[level]
