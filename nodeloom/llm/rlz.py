"""Substring deduplication by relative Lempel-Ziv parsing over words.

The reference is made of the table itself: of every phrase of span words that
a later document repeats, the first place that is known, put together to
fragments where such phrases overlap, so that a passage which many documents
share stands in it once, or a few times. It is cut into blocks by a hash of
the document that a fragment comes from. A block's index holds the phrases
that start in it. Each document is parsed against every block that can hold
anything of it: from left to right, at the first phrase that the index knows
of a document with a smaller id, the longest match becomes a factor; the
parse jumps over it and goes on with the phrases that reach over its end, so
that a passage which two factors cover is found whole. Words are compared, not
hashes. Each word that a factor of any block covers is a duplicate.

Which blocks a document is parsed against is found by hashes, in two steps
that keep most phrases from travelling. First only anchors are compared: of
the four-word grams in a phrase, the one with the smallest hash, which equal
phrases share and about two in eleven words start. Then the phrases around
anchors that other documents have too meet by hash. Some million words settle
among themselves first and send one record for a phrase or anchor, whatever
the number of their documents that hold it. So a passage in a third of all
documents costs a record per million words, and as many places in the
reference. A block that very many documents are parsed against is copied to
several tasks, which share them.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import heavy, parallelism, slices, stored
from .tokens import hashed, mixed, split, windows

SPAN, GRAM, BLOCK_WORDS = 13, 4, 1_000_000

#: A bucket's share of some million words: either settled (d, x: answers), or what others must settle, see pack().
MET = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("settled", T.BooleanType())] + [T.StructField(x, T.BinaryType()) for x in "hdxnwo"])
#: Answers for the documents of one part: their ids, and a number each.
REPLY = T.StructType([T.StructField("part", T.IntegerType())] + [T.StructField(x, T.BinaryType()) for x in "dx"])
FOUND = T.StructType([T.StructField("of", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("visits", T.ArrayType(T.LongType()))])
PIECE = T.StructType([T.StructField("block", T.LongType()), T.StructField("copy", T.IntegerType()), T.StructField("parsed", T.BooleanType()), T.StructField("of", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("text", T.StringType()), T.StructField("at", T.BinaryType())])
TAKEN = T.StructType([T.StructField("of", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("factors", T.BinaryType())])
FACTOR = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "n_words", "ref", "ref_start")])
_NONE = np.empty(0, np.int64)


def anchors(hashes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each phrase of span words the position of its smallest gram, the first of equal ones."""
    grams = windows(hashes, gram)
    width = span - gram + 1
    if len(grams) < width:
        return grams, _NONE
    best, where, covered = grams, np.arange(len(grams)), 1
    while covered < width:  # the smallest of twice as many, until all are covered
        shift = min(covered, width - covered)
        other = best[shift:]
        less = other < best[: len(other)]
        best, where = np.where(less, other, best[: len(other)]), np.where(less, where[shift:], where[: len(other)])
        covered += shift
    return grams, where


def tag(text: str) -> int:
    """31 bits of the text above 32 for a position: tells texts under one repeated id apart."""
    import xxhash

    return (xxhash.xxh32_intdigest(text.encode()) >> 1) << 32


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def distinct(d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[new], x[new]


def grouped(*keys):
    """(order, starts, group of each row) of rows sorted by all keys, groups by all but the last two."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys[:-2]:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def shared_anchor(h, d, p):
    """Of the anchors of some documents, those known to be in two, and what others must settle."""
    order, start, g = grouped(h, d, p)
    h, d, p = h[order], d[order], p[order]
    ends = np.append(start[1:], len(h)) - 1
    shared = (d[start] < d[ends])[g] if len(h) else np.empty(0, bool)
    one = start[shared[start]]
    rest = tuple(np.concatenate((x[~shared], y)) for x, y in ((h, h[one]), (d, d[one]), (p, np.full(len(one), -1))))
    return (d[shared], p[shared]), rest


def met_anchor(blocks):
    def settle(h, d, p):
        order, start, g = grouped(h, d, p)
        d, p = d[order], p[order]
        ends = np.append(start[1:], len(d)) - 1
        shared = (d[start] < d[ends])[g] & (p >= 0)
        return d[shared], p[shared]

    return settle


def repeated_phrase(h, a, d, p, blocks):
    """Answers for phrases with hash h around anchor a: -1 - block for a document that repeats one which a block of the reference will hold, the place of the phrase for the document that it comes from; and the rows that come first."""
    order, start, g = grouped(h, a, d, p)
    d, p = d[order], p[order]
    low = d[start][g]
    later = d > low
    home = start[np.add.reduceat(later, start) > 0]
    there = distinct(d[later], -1 - block_of(low[later], blocks))
    return (np.concatenate((there[0], d[home])), np.concatenate((there[1], p[home]))), order[start]


def shared_phrase(blocks):
    def settle(h, d, p, a, q):
        found, first = repeated_phrase(h, a, d, p, blocks)
        return found, tuple(x[first] for x in (h, d, p, a, q))

    return settle


def met_phrase(blocks):
    return lambda h, d, p, a: repeated_phrase(h, a, d, p, blocks)[0]


def pack(h, d, p, a=None, q=None):
    """Columns h to o of MET. Phrases (with a and q: hash and place of their anchor) share one entry per anchor; each adds its own hash and its distance from the anchor."""
    if a is None:
        return h.tobytes(), d.tobytes(), p.tobytes(), b"", b"", b""
    order = np.lexsort((p, q, d, a))
    h, d, p, a, q = (x[order] for x in (h, d, p, a, q))
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (q[1:] != q[:-1])))) if len(h) else _NONE
    n = np.diff(np.concatenate((start, [len(h)])))
    return a[start].tobytes(), d[start].tobytes(), q[start].tobytes(), n.astype(np.uint16).tobytes(), h.tobytes(), (q - p).astype(np.uint16).tobytes()


def unpack(h, d, p, n, w, o):
    h, d, p = np.frombuffer(h, np.uint64), np.frombuffer(d, np.int64), np.frombuffer(p, np.int64)
    if not n:
        return h, d, p
    n = np.frombuffer(n, np.uint16)
    return np.frombuffer(w, np.uint64), np.repeat(d, n), np.repeat(p, n) - np.frombuffer(o, np.uint16), np.repeat(h, n)


def _frame(rows, schema):
    import pyarrow as pa

    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema)], names=schema.names)


def by_first(batches, columns, work):
    """What work(rows) yields for all rows of one value in the first column after another; batches come sorted by it."""
    held, at = [], None
    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if key != at:
                if held:
                    yield from work(held)
                held, at = [], key
            held.append(row)
    if held:
        yield from work(held)


def meet(docs: DataFrame, records, within, between, block_words: int) -> DataFrame:
    """(of, at, visits) per document: the answers that within or between gave for it, at from 0 on and visits below.

    records(batch) -> (n_words, [(hashes, doc_id, positions, ..)]); within
    settles some million words, between a bucket of what these sent. The bucket
    goes by the hash, or by that of the anchor where records have one. Answers
    go to the part that the document's id names, packed, and become one row
    there. A task holds one bucket, or the answers of one part, at a time.
    """
    parts = parallelism(docs.sparkSession)
    buckets = 8 * parts

    def to_buckets(batches):
        def flush(held):
            h, p, *more = (np.concatenate([x[i] for x in held]) for i in (0, *range(2, len(held[0]))))
            d = np.repeat(np.array([x[1] for x in held], np.int64), [len(x[0]) for x in held])
            (sd, sx), rest = within(h, d, p, *more)
            rows = [(int(sd[i] % buckets), True, b"", sd[i : i + 65536].tobytes(), sx[i : i + 65536].tobytes(), b"", b"", b"") for i in range(0, len(sd), 65536)]
            bucket = (((rest[3] if more else rest[0]) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rest, bucket = [x[order] for x in rest], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else _NONE
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                rows.append((int(bucket[a]), False, *pack(*(x[a:b] for x in rest))))
            return _frame(rows, MET)

        held, words = [], 0
        for batch in slices(batches):
            n, found = records(batch)
            held += found
            words += n
            if words >= block_words and held:
                yield flush(held)
                held, words = [], 0
        if held:
            yield flush(held)

    def settle(batches):
        waiting: list = []

        def out():
            d, x = distinct(*map(np.concatenate, zip(*waiting)))
            waiting.clear()
            part = block_of(d, parts)
            order = np.argsort(part, kind="stable")
            d, x, part = d[order], x[order], part[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(d) else _NONE
            return _frame([(int(part[a]), d[a:b].tobytes(), x[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(d)])], REPLY)

        def bucket(rows):
            held = [unpack(h, d, x, *rest) for done, h, d, x, *rest in rows if not done]
            waiting.extend((np.frombuffer(d, np.int64), np.frombuffer(x, np.int64)) for done, _, d, x, *_ in rows if done)
            if held:
                waiting.append(between(*map(np.concatenate, zip(*held))))
            if sum(len(d) for d, _ in waiting) >= 1 << 20:
                yield out()

        yield from by_first(batches, MET.names, bucket)
        if waiting:
            yield out()

    def merge(batches):
        def part(rows):
            d, x = distinct(*(np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in (0, 1)))
            cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            ends = np.concatenate((cuts[1:], [len(d)]))
            middle = np.append(0, np.cumsum(x < 0))
            middle = cuts + middle[ends] - middle[cuts]  # answers below 0 come first
            for i in range(0, len(cuts), 4096):
                yield _frame([(int(d[a]), x[m:b].tobytes(), (-1 - x[a:m]).tolist()) for a, m, b in zip(cuts[i : i + 4096], middle[i : i + 4096], ends[i : i + 4096])], FOUND)

        yield from by_first(batches, REPLY.names, part)  # a part is as large as a shuffle partition

    replies = docs.mapInArrow(to_buckets, MET).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, REPLY)
    return replies.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, FOUND)


class Block:
    """The index of a block of the reference: fragments of documents as numbers of words, and where each phrase starts."""

    def __init__(self, span: int):
        self.span, self.vocabulary, self.parts, self.docs, self.places = span, {}, [], [], []
        self.ids = self.start = self.at = _NONE
        self.keys, self.shift, self.there = np.empty(0, np.uint64), np.uint64(63), np.zeros(2, bool)

    def add(self, doc: int, fragments: bytes, starts: np.ndarray) -> None:
        """Fragments are lines, their words parted by spaces; documents come by ascending id."""
        number = self.vocabulary
        for line, start in zip(fragments.split(b"\n"), starts.tolist()):
            ids = [number.setdefault(w, len(number)) for w in line.split(b" ")]
            self.parts.append(np.array([*ids, -1], np.int64))  # -1 matches no word, so that no factor leaves a fragment
            self.docs.append(doc)
            self.places.append(start)

    def build(self) -> None:
        self.ids = np.concatenate(self.parts)
        length = np.array([len(x) for x in self.parts])
        self.start = np.cumsum(length) - length
        self.parts = []
        inside = np.arange(len(self.ids)) - np.repeat(self.start, length)
        starts = np.flatnonzero(inside + self.span < np.repeat(length, length))
        keys = windows(mixed(self.ids.astype(np.uint64)), self.span)[starts]
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], starts[order]
        self.shift = np.uint64(64 - min(24, max(10, len(keys).bit_length() + 3)))
        self.there = np.zeros(1 << 64 - int(self.shift), bool)  # by the first bits of a key: most others are told here
        self.there[self.keys >> self.shift] = True

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-2)), np.int64, len(words))

    def match(self, ids: np.ndarray, at: int, place: int) -> int:
        """How many words from at on equal those from place on."""
        n, step, most = 0, 64, min(len(ids) - at, len(self.ids) - place)
        while n < most:
            m = min(step, most - n)
            same = ids[at + n : at + n + m] == self.ids[place + n : place + n + m]
            if not same.all():
                return n + int(same.argmin())
            n, step = n + m, 4 * step
        return n

    def parse(self, doc: int, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Greedy factors (start, words, document, its place there): at the first known phrase the longest match in a smaller document, then on from the phrases that reach over its end."""
        last = len(ids) - self.span
        hashes = windows(mixed(ids.astype(np.uint64)), self.span)
        out, at, high, known, left = [], 0, 0, _NONE, _NONE
        while at <= last:
            if at >= high:  # look some phrases up; those within a factor are jumped over
                low, high = at, min(last + 1, at + 1024)
                known = low + np.flatnonzero(self.there[hashes[low:high] >> self.shift])
                left = np.searchsorted(self.keys, hashes[known])
            i = int(np.searchsorted(known, at))
            if i == len(known):
                at = high
                continue
            at, k, key = int(known[i]), int(left[i]), hashes[known[i]]
            best, where = 0, 0
            while k < len(self.keys) and self.keys[k] == key:
                place, k = int(self.at[k]), k + 1
                piece = int(np.searchsorted(self.start, place, "right")) - 1
                if self.docs[piece] >= doc:
                    break
                n = self.match(ids, at, place)
                if n > best:
                    best, where = n, place
            if best < self.span:
                at += 1
                continue
            piece = int(np.searchsorted(self.start, where, "right")) - 1
            out.append((at, best, self.docs[piece], self.places[piece] + where - int(self.start[piece])))
            at += best - self.span + 1
        return out


def parse_all(named: DataFrame, found: DataFrame, blocks: int, span: int) -> DataFrame:
    """TAKEN: the factors of each of named (doc_id, text) against one of its blocks a row. found: of meet()."""
    spark = named.sparkSession
    parts = parallelism(spark)
    visits = found.select(F.explode("visits").alias("block")).groupBy("block").count()
    frequent, bound = heavy(visits, "count", visits.agg(F.sum("count")).first()[0] or 0)
    copies = {r["block"]: -(-r["count"] // bound) for r in frequent.collect()}  # at most 4 for each shuffle partition

    def pieces(batches):
        for batch in slices(batches):
            rows = []
            for doc, text, homes, there in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "visits"))):
                own = tag(text)
                homes = np.frombuffer(homes, np.int64)
                homes = homes[homes >> 32 << 32 == own] & 0xFFFFFFFF
                number = np.array([doc], np.int64)
                if len(homes):
                    words = text.encode().split()
                    first = np.flatnonzero(np.concatenate(([True], homes[1:] > homes[:-1] + span)))
                    ends = homes[np.append(first[1:], len(homes)) - 1] + span
                    fragments = b"\n".join(b" ".join(words[a:b]) for a, b in zip(homes[first].tolist(), ends.tolist())).decode()
                    block = int(block_of(number, blocks)[0])
                    rows += [(block, i, False, doc, own, fragments, homes[first].tobytes()) for i in range(copies.get(block, 1))]
                share = int(mixed(mixed(number.astype(np.uint64)))[0] >> np.uint64(33))
                rows += [(block, share % copies.get(block, 1), True, doc, own, text, None) for block in there]
            yield _frame(rows, PIECE)

    def run(batches):
        key, block = None, None
        for batch in slices(batches, 1024):
            out = []
            for *k, parsed, doc, own, text, at in zip(*(batch.column(c).to_pylist() for c in PIECE.names)):
                if k != key:
                    key, block = k, Block(span)
                if not parsed:
                    block.add(doc, text.encode(), np.frombuffer(at, np.int64))
                    continue
                if block.parts:
                    block.build()
                factors = block.parse(doc, block.numbers(split(text)))
                if factors:
                    out.append((doc, own, np.array(factors, np.int64).tobytes()))
            yield _frame(out, TAKEN)

    looked = named.join(found, F.col("doc_id") == F.col("of")).select("doc_id", "text", "at", "visits")
    dealt = looked.mapInArrow(pieces, PIECE).repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "parsed", "of")
    return dealt.mapInArrow(run, TAKEN)


def deduplicate(docs: DataFrame, span: int = SPAN, gram: int = GRAM, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, factors, spans of every row.

    Words are cut at ASCII white space. A word is removed if a phrase of span
    words over it also starts in a document with a smaller doc_id; phrases are
    judged on the input, not on what is left. kept_text has the other words
    with single spaces. spans (start, n_words) are the runs of removed words;
    factors (start, n_words, ref, ref_start) are those of
    all blocks, each a match with the words of ref from ref_start on; which of
    several places a passage is found at depends on how the table is cut into
    files and blocks, what they cover together does not. Texts may be of any
    length; null texts have no words; rows with a null id keep all words and
    take none from others; rows under one repeated id, equal ones too, don't
    take words from each other; an empty table gives an empty result. Other
    columns are ignored. Hashes only choose what is compared: a removed word
    always stands in the other document, and a phrase is missed if its 128
    bits of hash equal those of a different one.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = chosen.where("doc_id IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))  # of about six bytes a word

    def anchor_records(batch):
        n, out = 0, []
        for doc, hashes in zip(batch.column("doc_id").to_pylist(), hashed(batch.column("text").to_pylist())):
            n += len(hashes)
            if len(hashes) >= span:
                grams, best = anchors(hashes, span, gram)
                at = best[np.append(True, best[1:] != best[:-1])]  # they never go back
                out.append((grams[at], doc, at))
        return n, out

    def phrase_records(batch):
        n, out = 0, []
        texts = batch.column("text").to_pylist()
        for doc, text, hashes, known in zip(batch.column("doc_id").to_pylist(), texts, hashed(texts), batch.column("at").to_pylist()):
            n += len(hashes)
            if len(hashes) >= span:
                grams, best = anchors(hashes, span, gram)
                marked = np.zeros(len(hashes), bool)
                known = np.frombuffer(known, np.int64)
                marked[known[known < len(hashes)]] = True
                at = np.flatnonzero(marked[best])
                if len(at):
                    own = tag(text)
                    out.append((windows(hashes, span)[at], doc, at + own, grams[best[at]], best[at] + own))
        return n, out

    candidates = stored(meet(named, anchor_records, shared_anchor, met_anchor(blocks), block_words).select("of", "at"), "rlz")
    looked = named.join(candidates, F.col("doc_id") == F.col("of")).select("doc_id", "text", "at")
    found = stored(meet(looked, phrase_records, shared_phrase(blocks), met_phrase(blocks), block_words), "rlz")
    taken = stored(parse_all(named, found, blocks, span), "rlz")
    taken = taken.groupBy("of").agg(F.collect_list(F.struct("tag", "factors")).alias("taken"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("factors", T.ArrayType(FACTOR)), T.StructField("spans", T.ArrayType(T.StructType(FACTOR.fields[:2])))])

    def kept(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *(pa.list_(pa.struct([(x, pa.int64()) for x in FACTOR.names[:n]])) for n in (4, 2))]
        for batch in slices(batches):
            rows = []
            for doc, text, taken in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "taken"))):
                words = split(text)
                factors, gone = [], np.zeros(len(words), bool)
                if taken:
                    own = tag(text)
                    own_factors = [np.frombuffer(t["factors"], np.int64).reshape(-1, 4) for t in taken if t["tag"] == own]
                    factors = sorted({tuple(f) for part in own_factors for f in part.tolist()})
                    for start, n, _, _ in factors:
                        gone[start : start + n] = True
                left = [w for w, g in zip(words, gone.tolist()) if not g] if factors else words
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
                spans = [{"start": a, "n_words": b - a} for a, b in edge]
                rows.append((doc, len(words), int(gone.sum()), b" ".join(left).decode(), [dict(zip(FACTOR.names, f)) for f in factors], spans))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=schema.names)

    return chosen.join(taken, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "taken").mapInArrow(kept, schema)
