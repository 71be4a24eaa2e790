"""Chroma audio fingerprints and the alignment of recordings.

Sound becomes frames of 12 pitch classes; filters compare sums over
rectangles of that image, read off its integral image at four corners each;
every filter gives two bits by its response, in Gray code, and 16 of them make
a 32-bit integer per frame. Two recordings are aligned by a histogram of the
offsets at which their integers share one of several bands of bits, which
cover all 32; every offset with enough votes is verified, and so is every one
with a short overlap, where votes are too few. The share of bits that differ
there tells whether it is the same sound.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

RATE, FRAME, HOP = 11025, 4096, 1365
LOWEST, HIGHEST = 55.0, 3520.0
#: (kind, first pitch class, classes, frames): every kind at several places and sizes.
FILTERS = [(i % 5, (5 * i) % (13 - h), h, w) for i, (h, w) in enumerate(zip((2, 4, 6, 12, 4, 8, 6, 2, 12, 4, 6, 8, 2, 12, 4, 6), (4, 8, 6, 12, 16, 4, 8, 12, 6, 4, 12, 8, 16, 4, 6, 8)))]
WIDEST = max(f[3] for f in FILTERS)
STEP = 0.18  # responses beyond it, either way, get the outer codes
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Bands of BAND_BITS bits start every 32 / BANDS bits and go round. An offset with LEAST_VOTES shared bands and as many frames of overlap is verified, one of at most SHORT frames of overlap without votes.
BANDS, BAND_BITS, LEAST_VOTES, SHORT, MOST_ERROR = 8, 14, 3, 20, 0.25


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate) of PCM with 8 or 16 bits, channels averaged; nothing for what isn't such a file."""
    none = np.zeros(0), RATE
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind = struct.unpack_from("<HHIIHH", body)
        elif name == b"data" and kind and kind[0] == 1 and kind[5] in (8, 16) and kind[1] and kind[2]:
            width = kind[5] // 8 * kind[1]
            raw = np.frombuffer(body[: len(body) // width * width], "<i2" if kind[5] == 16 else np.uint8)
            x = raw / 32768.0 if kind[5] == 16 else (raw - 128.0) / 128
            return x.reshape(-1, kind[1]).mean(1), kind[2]
        at += 8 + size + size % 2
    return none


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


_fixed: list = []


def _window_and_classes():
    if not _fixed:
        frequency = np.arange(FRAME // 2 + 1) * RATE / FRAME
        heard = (frequency >= LOWEST) & (frequency <= HIGHEST)
        classes = np.zeros((len(frequency), 12))
        classes[np.flatnonzero(heard), np.round(12 * np.log2(frequency[heard] / 440)).astype(int) % 12] = 1
        _fixed.append((np.hanning(FRAME), classes))
    return _fixed[0]


def pitch_classes(samples: np.ndarray, rate: int) -> np.ndarray:
    """A row of 12 per frame, smoothed over five frames and of length 1; silence gives zeros."""
    if rate != RATE and len(samples):
        samples = np.interp(np.arange(int(len(samples) * RATE / rate)) * rate / RATE, np.arange(len(samples)), samples)
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    window, classes = _window_and_classes()
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.concatenate([(np.abs(np.fft.rfft(frames[i : i + 64] * window)) ** 2) @ classes for i in range(0, len(frames), 64)])
    padded = np.pad(out, ((2, 2), (0, 0)))
    out = sum(c * padded[i : i + len(out)] for i, c in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-12), 0.0)


def pack(chroma: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place that the widest filter fits at."""
    n = len(chroma) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, t1, y0, y1):
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if kind == 0:  # the classes against the others
            one, other = whole / h, (area(0, w, 0, 12) - whole) / max(12 - h, 1)
        elif kind == 1:  # lower against upper half
            one = area(0, w, y, y + h // 2)
            other = whole - one
        elif kind == 2:  # earlier against later half
            one = area(0, w // 2, y, y + h)
            other = whole - one
        elif kind == 3:  # the two diagonals
            one = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            other = whole - one
        else:  # middle against both ends in time
            one = area(w // 4, w - w // 4, y, y + h)
            other = whole - one
        response = np.log((1 + one) / (1 + other))
        level = (response > -STEP).astype(int) + (response > 0) + (response > STEP)
        packed = packed << np.uint32(2) | GRAY[level]
    return packed


def fingerprint(data: bytes | None) -> np.ndarray:
    return pack(pitch_classes(*decode_wav(data)))


def fingerprints(clips: DataFrame, load=bytes, id_col: str = "clip_id", audio_col: str = "audio") -> DataFrame:
    """clip_id, frames (array<int>) of every row.

    load(value of audio_col) gives the bytes of a WAV file; null, broken, empty
    and very short sounds have no frames. Long ones are taken whole. Repeated
    rows give repeated results, other columns are ignored.
    """
    schema = T.StructType([T.StructField("clip_id", T.LongType()), T.StructField("frames", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 64):
            out = [fingerprint(None if x is None else load(x)).view(np.int32) for x in batch.column("audio").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return clips.select(F.col(id_col).cast("long").alias("clip_id"), F.col(audio_col).alias("audio")).mapInArrow(run, schema)


def bands(frames: np.ndarray) -> np.ndarray:
    """The bands of every integer, one band after the other, each under its number."""
    out = []
    for k in range(BANDS):
        shift = 32 // BANDS * k
        turned = frames << np.uint32(shift) | frames >> np.uint32(32 - shift) if shift else frames
        out.append(np.uint32(k << BAND_BITS) | turned >> np.uint32(32 - BAND_BITS))
    return np.concatenate(out)


def band_index(queries: list[np.ndarray]):
    """(keys, owners, places, integers, starts, lengths, heads, tails) of the queries: their bands, sorted, with query and place; all integers in a row; the first and the last SHORT, a column per query."""
    lengths = np.array([len(q) for q in queries], np.int64)
    integers = np.concatenate([*queries, np.zeros(0, np.uint32)]).astype(np.uint32)
    starts = np.cumsum(lengths) - lengths
    owners = np.repeat(np.arange(len(queries)), lengths)
    keys = bands(integers)
    order = np.argsort(keys, kind="stable")
    frame = order % max(len(integers), 1)
    along, last = np.arange(SHORT)[:, None], max(len(integers) - 1, 0)
    heads, tails = (integers[np.clip(x, 0, last)] if len(integers) else np.zeros((SHORT, 0), np.uint32) for x in (starts + along, starts + lengths - SHORT + along))
    return keys[order], owners[frame].astype(np.int32), (frame - starts[owners[frame]]).astype(np.int32), integers, starts, lengths, heads, tails


def short_overlaps(frames: np.ndarray, lengths, heads, tails):
    """(queries, offsets): within MOST_ERROR at an end of frames with at most SHORT frames of overlap, or with a recording that short."""
    found = []
    for m in range(LEAST_VOTES, min(SHORT, len(frames)) + 1):
        for own, other, offset in ((frames[-m:], heads[:m], len(frames) - m), (frames[:m], tails[SHORT - m :], m - lengths)):
            bits = np.bitwise_count(own[:, None] ^ other).sum(0, dtype=np.uint16)
            near = np.flatnonzero((bits <= MOST_ERROR * 32 * m) & (lengths >= m))
            if len(near):
                found.append((near, np.broadcast_to(offset, lengths.shape)[near]))
    for q in np.flatnonzero(np.minimum(lengths, len(frames)) <= SHORT):
        offsets = np.arange(LEAST_VOTES - lengths[q], len(frames) - LEAST_VOTES + 1)
        found.append((np.full(len(offsets), q), offsets))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def alignments(frames: np.ndarray, keys, owners, places, integers, starts, lengths, heads, tails):
    """(query, offset, votes, overlap, bit error) of each query that aligns with frames.

    The rest is a band_index(). Of the offsets within MOST_ERROR, the one with
    most votes counts. offset: place in frames less place in the query.
    """
    if not len(frames) or not len(integers):
        return []
    own = bands(frames)
    lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
    n = hi - lo
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    longest = int(lengths.max())
    span = longest + len(frames)
    codes = np.sort(owners[which] * np.int64(span) + (np.repeat(np.arange(len(own)) % len(frames), n) - places[which] + longest))
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    votes = np.diff(np.append(first, len(codes)))
    codes = codes[first]
    query, offset = short_overlaps(frames, lengths, heads, tails)
    chosen = np.unique(np.concatenate((codes[votes >= LEAST_VOTES], query * np.int64(span) + offset + longest)))
    place = np.minimum(np.searchsorted(codes, chosen), max(len(codes) - 1, 0))
    votes = np.where(codes[place] == chosen, votes[place], 0) if len(codes) else np.zeros(len(chosen), np.int64)
    query, offset = np.divmod(chosen, span)
    offset = offset - longest
    at = np.maximum(offset, 0)
    length = np.minimum(len(frames) - at, lengths[query] - (at - offset))
    wide = length >= LEAST_VOTES
    query, offset, votes, at, length = (x[wide] for x in (query, offset, votes, at, length))
    error = np.zeros(len(query))
    step = max(1, 4_000_000 // max(len(frames), 1))
    for i in range(0, len(query), step):
        part = slice(i, i + step)
        ends = np.cumsum(length[part])
        along = np.arange(ends[-1]) - np.repeat(ends - length[part], length[part])
        a = frames[along + np.repeat(at[part], length[part])]
        b = integers[along + np.repeat(starts[query[part]] + at[part] - offset[part], length[part])]
        error[part] = np.add.reduceat(np.bitwise_count(a ^ b), ends - length[part], dtype=np.int64) / (32 * length[part])
    near = np.flatnonzero(error <= MOST_ERROR)
    near = near[np.lexsort((np.abs(offset[near]), -votes[near], query[near]))]
    near = near[np.concatenate(([True], query[near][1:] != query[near][:-1]))[: len(near)]]
    return list(zip(*(x[near].tolist() for x in (query, offset, votes, length, error))))


def search(known: DataFrame, queries: DataFrame, block: int = 10_000, summed: bool = False) -> DataFrame:
    """query_id, clip_id, offset, votes, overlap, bit_error: which of known (clip_id, frames) align with queries of the same columns.

    Queries are taken in blocks of about block recordings, or fewer where they
    are long; each is indexed, shipped and held against all of known where that
    lies, so that one pass over known is made for each block and nothing is
    shuffled. summed: clip_id, n_links, and bit_error, query_id, offset of the
    best instead, a row for each of known that a block aligns with, without itself.
    """
    spark = known.sparkSession
    n, frames = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("frames")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-frames // (64 * block)))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("clip_id", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("votes", T.IntegerType()), T.StructField("overlap", T.IntegerType()), T.StructField("bit_error", T.DoubleType())])
    if summed:
        schema = T.StructType([T.StructField("clip_id", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("bit_error", T.DoubleType()), T.StructField("query_id", T.LongType()), T.StructField("offset", T.IntegerType())])
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("clip_id"), F.lit(blocks)) == b).collect()
        packed = [np.array(r["frames"], np.int32).view(np.uint32) for r in rows]
        index = spark.sparkContext.broadcast((band_index(packed), [r["clip_id"] for r in rows]))

        def run(batches, index=index):
            import pyarrow as pa

            own, ids = index.value
            for batch in slices(batches, 1024):
                out = []
                for clip, frames in zip(batch.column("clip_id").to_pylist(), batch.column("frames").to_pylist()):
                    links = [(ids[q], clip, d, v, n, e) for q, d, v, n, e in alignments(np.array(frames, np.int32).view(np.uint32), *own)]
                    if summed:
                        links = [x for x in links if x[0] != clip]
                        out += [(clip, len(links), *min((e, q, d) for q, _, d, _, _, e in links))] if links else []
                    else:
                        out += links
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()) if summed else (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=schema.names)

        one = known.select("clip_id", "frames").mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def matched(clips: DataFrame, is_query, load=bytes, id_col: str = "clip_id", audio_col: str = "audio") -> DataFrame:
    """clip_id, frames, class_id, n_links, best_query, offset, bit_error of every row.

    Recordings with equal frames are one class, named by its smallest id and
    searched once. Queries are the classes with an id for which is_query(id)
    holds. n_links counts the query classes that a class aligns with, its own
    left out; best_query is the one of the lowest bit error. Rows without
    frames or with a null id are linked with nothing.
    """
    known = stored(fingerprints(clips, load, id_col, audio_col).withColumn("digest", F.when(F.size("frames") > 0, F.sha2(F.array_join("frames", ","), 256))), "chroma")
    classes = known.where("clip_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("clip_id").alias("clip_id"), F.first("frames").alias("frames"), F.max(is_query(F.col("clip_id"))).alias("asks"))
    classes = stored(classes, "chroma")
    links = search(classes, classes.where("asks").select("clip_id", "frames"), summed=True)
    best = F.min(F.struct("bit_error", "query_id", "offset"))
    links = links.groupBy("clip_id").agg(F.sum("n_links").alias("n_links"), best.alias("best"))
    of = classes.select("digest", F.col("clip_id").alias("class_id")).join(links.withColumnRenamed("clip_id", "c"), F.col("class_id") == F.col("c"), "left")
    found = known.join(of.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("clip_id").isNotNull(), "left")
    return found.select("clip_id", "frames", F.coalesce("class_id", "clip_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("best.query_id").alias("best_query"), F.col("best.offset").alias("offset"), F.col("best.bit_error").alias("bit_error"))


def sonify(vector: list[float], seconds: float = 0.125) -> bytes:
    """A WAV file with a note for each number: its size chooses one of 48 pitches from 110 Hz on."""
    x = np.nan_to_num(np.array([0.0 if v is None else v for v in vector], float))
    pitch = np.clip(np.round(24 + x * 72), 0, 47)
    n = int(RATE * seconds)
    t = np.arange(n) / RATE
    notes = np.sin(2 * np.pi * 110 * 2 ** (pitch[:, None] / 12) * t) * np.minimum(1, np.minimum(np.arange(n), np.arange(n)[::-1]) / 60)
    return encode_wav(0.6 * notes.ravel())
