"""Line deduplication with a segment-partition edit join.

Lines are compared as characters. A line of some length may differ from
another by a number t of edits that the table of edits names for that length
(of two lines the shorter one counts): by default none below 32 characters,
one below 96, two from there on. It is cut into t + 1 segments; whoever is
within t edits of it holds one of them unchanged, at a place that the lengths
and the number of the segment confine to a few. So each line is indexed under
the hash of (length, number, segment) and probes, for its own length and those
that are shorter by up to t, the substrings at these few places. Entries meet
in buckets of that hash. Pairs whose character counts differ in parity more
than t edits can explain are left out there; the others are verified with a
bit-parallel edit distance in a band of 2t + 1 diagonals.

A line goes if any earlier line is near, so one is enough. A segment that more
than GROUP different lines share lists no pairs: its lines are dealt into
blocks, two blocks meet in a task, and there each line is held against the
earlier ones whose character and bigram parities admit it, until one is near.

All hashing is done on arrays of characters, a few hundred documents at a
time: prefix sums of a polynomial give the hash of any substring at once.
Entries travel as packed arrays, one row per task and bucket. Lines are told
apart by two such hashes of 64 bits; near ones are compared as texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, fresh, heavy, let, parallelism, slices, stored
from .tokens import mixed

#: (least length, edits): the default.
EDITS = ((32, 1), (96, 2))
#: So many different lines under one key are paired where they meet; more are dealt into blocks of about BLOCK_CHARS characters.
GROUP, BLOCK_CHARS = 128, 1 << 23
#: About so many characters are cut into lines at once.
PIECE = 1 << 19
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CLASS = np.uint64(31)


def allowed(length: int, edits=EDITS) -> int:
    return max((t for least, t in edits if length >= least), default=0)


class _Tables:
    """Powers and the values of characters, made once in a worker."""

    def __init__(self):
        self.value = mixed(np.arange(0x110000, dtype=np.uint64) + np.uint64(_FACTORS[0]))
        self.bit = np.uint32(1) << (self.value >> np.uint64(59)).astype(np.uint32)
        self.bit[10] = 0
        self.power = [(np.ones(1, np.uint64),) * 2] * 2  # of each factor, and of its inverse

    def grow(self, n: int) -> None:
        if len(self.power[0][0]) < n:
            for i, factor in enumerate(_FACTORS):
                both = []
                for x in (factor, pow(factor, -1, 1 << 64)):
                    steps = np.full(n + n // 4, x, np.uint64)
                    steps[0] = 1
                    both.append(np.multiply.accumulate(steps))
                self.power[i] = tuple(both)


_tables: list[_Tables] = []


class Cut:
    """The lines of some texts: number of the text, number of the line in it, length, hash, and the hash of any part."""

    def __init__(self, texts: list[str]):
        claim("lines", _tables.clear)
        if not _tables:
            _tables.append(_Tables())
        t = self.tables = _tables[0]
        chars = self.chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        t.grow(len(chars) + 1)
        self.inverse = t.power[0][1]
        self.sums = self.sum_up(0)
        breaks = np.flatnonzero(chars == 10)
        self.start = np.concatenate(([0], breaks + 1))
        self.length = np.concatenate((breaks, [len(chars)])) - self.start
        heads = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
        self.text = np.searchsorted(heads, self.start, "right") - 1
        self.number = np.arange(len(self.start)) - np.searchsorted(self.start, heads)[self.text]
        blank = np.concatenate(([0], np.cumsum((chars > 32) & (chars != 160))))
        self.blank = blank[self.start + self.length] == blank[self.start]
        self.id = self.part(np.arange(len(self.start)), 0, self.length) >> np.uint64(1)  # 63 bits
        padded = np.concatenate((t.bit[chars], np.zeros(1, np.uint32)))
        self.parity = np.bitwise_xor.reduceat(padded, self.start)

    def sum_up(self, which: int) -> np.ndarray:
        sums = np.zeros(len(self.chars) + 1, np.uint64)
        np.cumsum(self.tables.value[self.chars] * self.tables.power[which][0][: len(self.chars)], out=sums[1:])
        return sums

    def part(self, which, offset, length):
        """Hash of the characters offset to offset + length of lines."""
        at = self.start[which] + offset
        return mixed((self.sums[at + length] - self.sums[at]) * self.inverse[at] + np.asarray(length, np.int64).astype(np.uint64))

    def check(self) -> np.ndarray:
        """A second hash of every line."""
        sums, stop = self.sum_up(1), self.start + self.length
        return mixed((sums[stop] - sums[self.start]) * self.tables.power[1][1][self.start]).view(np.int64)

    def bigrams(self) -> np.ndarray:
        """64 bits per line: which of 64 classes of two characters side by side are there an odd number of times. An edit changes four at most."""
        value = self.tables.value[self.chars]
        first = mixed(value[:-1] * np.uint64(3) + value[1:]) >> np.uint64(58)
        bit = np.uint64(1) << first
        bit[(self.chars[:-1] == 10) | (self.chars[1:] == 10)] = 0
        return np.bitwise_xor.reduceat(np.concatenate((bit, np.zeros(2, np.uint64))), self.start)


def cuts(texts: list[str], most: int = PIECE):
    """Cut after Cut of all lines of the texts, each of about most characters, so that memory doesn't grow with the texts: longer ones are taken apart at line feeds. Numbers of texts and lines are those in the whole."""
    held, size = [], 0

    def made():
        rows, firsts = np.array([r for r, _, _ in held]), np.array([f for _, f, _ in held])
        found = Cut([x for _, _, x in held])
        found.number, found.text = found.number + firsts[found.text], rows[found.text]
        held.clear()
        return found

    for row, text in enumerate(texts):
        at = first = 0
        while at <= len(text):
            stop = len(text)
            if stop - at > most:
                stop = text.rfind("\n", at, at + most)
                stop = text.find("\n", at + most) if stop < 0 else stop
                stop = len(text) if stop < 0 else stop
            if held and size + stop - at > most:
                yield made()
                size = 0
            held.append((row, first, text[at:stop]))
            size, first, at = size + stop - at, first + text.count("\n", at, stop) + 1, stop + 1
    if held:
        yield made()


def places(t: int, shorter: int):
    """(segment from 0, shift) at which a line holds a segment of one that is shorter by so many and within t edits."""
    for i in range(t + 1):
        for d in range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1):
            yield i, d


def entries(lines: Cut, which: np.ndarray, edits=EDITS):
    """(keys, ids with a low bit that is 1 for index entries, parities) of the lines numbered which. The low five bits of a key tell about how long its lines are."""
    out = []
    lengths = lines.length[which]
    for n, (least, t) in enumerate(edits):
        most = edits[n + 1][0] if n + 1 < len(edits) else None
        for shorter in range(t + 1):
            other = lengths - shorter
            chosen = which[(other >= least) & ((other < most) if most else True)]
            if not len(chosen):
                continue
            other = lines.length[chosen] - shorter
            size, longer = other // (t + 1), other % (t + 1)
            about = np.frexp(other)[1].astype(np.uint64)
            for i, d in places(t, shorter):
                at = i * size + np.maximum(0, i - (t + 1 - longer)) + d
                long = size + (i >= t + 1 - longer)
                ok = (at >= 0) & (at + long <= lines.length[chosen])
                c = chosen[ok]
                keys = mixed(lines.part(c, at[ok], long[ok]) ^ mixed((other[ok] * 16 + i).astype(np.uint64)))
                index = np.uint64(shorter == 0 and d == 0)
                out.append((keys & ~_CLASS | about[ok], lines.id[c] << np.uint64(1) | index, lines.parity[c]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32))


def met(keys, ids, parities, most: int, group: int = GROUP, chunk: int = 2_000_000):
    """(pairs, keys, ids, sizes): distinct (a, b), a < b, of lines that share a key, one of them indexed, and that few edits can explain; and all entries of keys that more than group lines share, with their number."""
    order = np.lexsort((ids, keys))
    keys, ids, parities = keys[order], ids[order], parities[order]
    once = np.ones(len(keys), bool)  # the same line comes from many tasks
    once[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, parities = keys[once], ids[once], parities[once]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((start, [len(keys)])))
    sizes = np.repeat(size, size)
    large = sizes > group
    rest = keys[large], ids[large], sizes[large]
    rank = np.arange(len(keys)) - np.repeat(start, size)  # pairs with each earlier entry of the group
    rank[large] = 0
    upto = np.concatenate(([0], np.cumsum(rank)))
    found, at = [], 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + chunk, "right")) - 1)
        r = rank[at:to]
        right = np.repeat(np.arange(at, to), r)
        left = np.arange(len(right)) - np.repeat(np.cumsum(r) - r, r) + np.repeat(np.arange(at, to) - r, r)
        ok = ((ids[left] | ids[right]) & np.uint64(1) == 1) & (ids[left] >> np.uint64(1) != ids[right] >> np.uint64(1))
        left, right = left[ok], right[ok]
        ok = np.bitwise_count(parities[left] ^ parities[right]) <= 2 * most
        a, b = (ids[x[ok]] >> np.uint64(1) for x in (left, right))
        if len(a):
            found.append(np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0))
        at = to
    return np.unique(np.concatenate(found), axis=0).astype(np.int64) if found else np.empty((0, 2), np.int64), *rest


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance is t at most: a band of 2t + 1 diagonals in the bits of an integer, one step per character."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > t:
        return False
    if a == b:
        return True
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(a), len(b)
    if not m:
        return n <= t
    # Bit k of a vector stands for the cell in row i + k - t of column i; differences between neighboring cells are +1 (plus), -1 (minus) or 0.
    width = 2 * t + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + t)
    plus, minus, score = full ^ ((1 << t) - 1), 0, t  # the cell in row t of column 0
    rows = t
    for i, c in enumerate(b):
        match = where.get(c, 0) >> i & full
        diagonal = ((match & plus) + plus ^ plus | match | minus) & full
        across = minus | full & ~(diagonal | plus)
        back = diagonal & plus
        if rows < n:  # along the band's lowest diagonal
            score += not diagonal & top
            rows += 1
        else:  # along the last row
            bit = 1 << (n - 1 - i + t)
            score += bool(across & bit) - bool(back & bit)
        shifted = diagonal >> 1
        plus = (back | full & ~(shifted | across)) & full
        minus = shifted & across
    return score <= t if rows == n else score - (rows - n) <= t


def _arrow(columns, schema):
    import pyarrow as pa

    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema)], names=schema.names)


def _schema(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINE = _schema(id=T.LongType(), check=T.LongType())


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, check, doc_id, tag, line) of every line that isn't blank; tag is a hash of the whole text."""
    schema = _schema(id=T.LongType(), check=T.LongType(), doc_id=T.LongType(), tag=T.LongType(), line=T.LongType())

    def run(batches):
        for batch in slices(batches):
            for lines in cuts(batch.column("text").to_pylist()):
                keep = np.flatnonzero(~lines.blank)
                doc, tag = (batch.column(c).to_numpy(zero_copy_only=False)[lines.text[keep]] for c in ("doc_id", "tag"))
                yield _arrow((lines.id[keep].astype(np.int64), lines.check()[keep], doc, tag, lines.number[keep]), schema)

    return docs.mapInArrow(run, schema)


def meetings(docs: DataFrame, edits=EDITS, group: int = GROUP, chars_per_block: int = 8_000_000) -> DataFrame:
    """Rows of two kinds: (a, b), a pair of ids of lines that may be near, and (a, key, flag, n), a line among n under a key that more than group of them share; flag is 1 if it is indexed there."""
    parts = parallelism(docs.sparkSession)
    buckets = 8 * parts
    least, most = edits[0][0], max(t for _, t in edits)
    blobs = _schema(bucket=T.IntegerType(), keys=T.BinaryType(), ids=T.BinaryType(), parities=T.BinaryType())
    out = _schema(a=T.LongType(), b=T.LongType(), key=T.LongType(), flag=T.IntegerType(), n=T.LongType())

    def to_buckets(batches):
        def flush(held):
            keys, ids, parities = map(np.concatenate, zip(*held))
            bucket = ((keys >> np.uint64(35)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, ids, parities, bucket = keys[order], ids[order], parities[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
            rows = [(int(bucket[a]), keys[a:b].tobytes(), ids[a:b].tobytes(), parities[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
            return _arrow(zip(*rows) if rows else [[]] * 4, blobs)

        held, chars, seen = [], 0, np.empty(0, np.uint64)
        for lines in (x for batch in slices(batches) for x in cuts(batch.column("text").to_pylist())):
            _, once = np.unique(lines.id, return_index=True)
            once = once[~np.isin(lines.id[once], seen) & (lines.length[once] >= least) & ~lines.blank[once]]
            seen = np.concatenate((seen, lines.id[once]))
            held.append(entries(lines, once, edits))
            chars += int(lines.length.sum())
            if chars >= chars_per_block:
                yield flush(held)
                held, chars, seen = [], 0, np.empty(0, np.uint64)
        if held:
            yield flush(held)

    def to_pairs(batches):
        def settle(held):
            pairs, keys, ids, sizes = met(*map(np.concatenate, zip(*held)), most, group)
            yield _arrow((pairs[:, 0], pairs[:, 1], [None] * len(pairs), [None] * len(pairs), [None] * len(pairs)), out)
            for i in range(0, len(keys), 1 << 16):
                k, x, n = keys[i : i + (1 << 16)], ids[i : i + (1 << 16)], sizes[i : i + (1 << 16)]
                yield _arrow(((x >> np.uint64(1)).astype(np.int64), [None] * len(k), k.view(np.int64), (x & np.uint64(1)).astype(np.int32), n), out)

        held, at = [], None  # one bucket at a time
        for batch in batches:
            for bucket, k, i, p in zip(*(batch.column(c).to_pylist() for c in blobs.names)):
                if bucket != at:
                    if held:
                        yield from settle(held)
                    held, at = [], bucket
                held.append((np.frombuffer(k, np.uint64), np.frombuffer(i, np.uint64), np.frombuffer(p, np.uint32)))
        if held:
            yield from settle(held)

    return docs.mapInArrow(to_buckets, blobs).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(to_pairs, out)


def texts_of(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(id, check, line, doc, place) of the lines whose ids are wanted: the text, and where it comes first."""
    schema = _schema(id=T.LongType(), check=T.LongType(), line=T.StringType())

    def run(batches):
        for texts, lines in ((texts, x) for batch in slices(batches) for texts in [batch.column("text").to_pylist()] for x in cuts(texts)):
            _, once = np.unique(lines.id, return_index=True)
            once = once[lines.length[once] >= least]
            cut_texts = {t: texts[t].split("\n") for t in set(lines.text[once].tolist())}
            yield _arrow((lines.id[once].astype(np.int64), lines.check()[once], [cut_texts[t][n] for t, n in zip(lines.text[once].tolist(), lines.number[once].tolist())]), schema)

    found = docs.mapInArrow(run, schema).join(wanted, F.col("id") == F.col("want")).groupBy("id", "check").agg(F.first("line").alias("line"))
    first = firsts.select(F.col("id").alias("i"), F.col("check").alias("c"), F.col("first.doc_id").alias("doc"), F.col("first.line").alias("place"))
    return found.join(first, (F.col("id") == F.col("i")) & (F.col("check") == F.col("c"))).select("id", "check", "line", "doc", "place")


def late_of_pairs(pairs: DataFrame, texts: DataFrame, edits=EDITS) -> DataFrame:
    """(id, check): of each pair (a, b) that is near, the line that comes later."""
    side = lambda n: texts.toDF(*(f"{n}_{c}" for c in texts.columns))
    both = pairs.join(side("x"), F.col("a") == F.col("x_id")).join(side("y"), F.col("b") == F.col("y_id"))
    x, y = F.struct("x_doc", "x_place"), F.struct("y_doc", "y_place")
    both = both.where(x != y).select("x_line", "y_line", F.when(x > y, F.col("x_id")).otherwise(F.col("y_id")).alias("id"), F.when(x > y, F.col("x_check")).otherwise(F.col("y_check")).alias("check"))

    def run(batches):
        for batch in slices(batches, 4096):
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "check", "x_line", "y_line")))
            good = {(i, c) for i, c, a, b in rows if within(a, b, allowed(min(len(a), len(b)), edits))}
            yield _arrow(zip(*good) if good else [[], []], LINE)

    return both.mapInArrow(run, LINE)


def late_in_block(rows: list[tuple], pair: tuple[int, int], edits=EDITS) -> list[tuple[int, int]]:
    """(id, check) of the lines that an earlier one is near to, of rows (block, id, check, flag, line, doc, place). Where two blocks meet, only lines of different blocks are compared."""
    rows = sorted(rows, key=lambda r: r[5:7])
    most = max(t for _, t in edits)
    lines = [r[4] for r in rows]
    block, flag = np.array([r[0] for r in rows]), np.array([r[3] for r in rows], bool)
    places_ = [r[5:7] for r in rows]
    first = np.arange(len(rows))  # the first row at the same place
    for i in range(1, len(rows)):
        if places_[i] == places_[i - 1]:
            first[i] = first[i - 1]
    parity, bigrams = np.empty(len(rows), np.uint32), np.empty(len(rows), np.uint64)
    at = 0
    while at < len(rows):  # some characters at a time
        to, size = at, 0
        while to < len(rows) and size < 1 << 20:
            size, to = size + len(lines[to]) + 1, to + 1
        found = Cut(lines[at:to])
        parity[at:to], bigrams[at:to] = found.parity, found.bigrams()
        at = to
    out, step = [], max(1, (1 << 21) // max(1, len(rows)))
    for start in range(0, len(rows), step):
        stop = min(len(rows), start + step)
        near = np.bitwise_count(bigrams[start:stop, None] ^ bigrams[:stop]) <= 4 * most
        near &= np.bitwise_count(parity[start:stop, None] ^ parity[:stop]) <= 2 * most
        near &= flag[start:stop, None] | flag[:stop]
        near &= np.arange(stop) < first[start:stop, None]
        if pair[0] != pair[1]:
            near &= block[start:stop, None] != block[:stop]
        for y in np.flatnonzero(near.any(1)):
            own = lines[start + y]
            if any(within(own, lines[x], allowed(min(len(own), len(lines[x])), edits)) for x in np.flatnonzero(near[y])):
                out.append(rows[start + y][1:3])
    return out


def late_of_groups(members: DataFrame, texts: DataFrame, edits=EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, check): the lines of large groups (a, key, flag, n) that an earlier one of the group is near to."""
    size = F.least(F.greatest(F.expr(f"shiftright({block_chars}, cast(key & 31 AS INT))"), F.lit(16)), F.lit(65536))
    placed = members.withColumn("blocks", F.ceil(F.col("n") / size).cast("int")).join(texts, F.col("a") == F.col("id"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id", "check"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j")))
    columns = ["key", "i", "j", "own", "id", "check", "flag", "line", "doc", "place"]
    placed = placed.withColumn("at", F.explode(pair)).select("key", "at.i", "at.j", *columns[3:])
    placed = placed.repartition(parallelism(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        key, rows = None, []
        for batch in slices(batches, 4096):
            out = []
            for *k, own, line_id, check, flag, line, doc, place in zip(*(batch.column(c).to_pylist() for c in columns)):
                if k != key:
                    out += late_in_block(rows, key[1:], edits) if rows else []
                    key, rows = k, []
                rows.append((own, line_id, check, flag, line, doc, place))
            yield _arrow(zip(*out) if out else [[], []], LINE)
        if rows:
            out = late_in_block(rows, key[1:], edits)
            yield _arrow(zip(*out) if out else [[], []], LINE)

    return placed.mapInArrow(run, LINE)


def repeated_lines(docs: DataFrame, edits=EDITS, group: int = GROUP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(of, of_tag, gone): for documents (doc_id, tag, text), the numbers of the lines that an earlier line is equal or near to."""
    seen = stored(occurrences(docs), "lines")
    firsts = cut(seen.groupBy("id", "check").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")))
    found = stored(meetings(docs, edits, group), "lines")
    pairs = cut(found.where("key IS NULL").select("a", "b").distinct())
    members = found.where("key IS NOT NULL")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("want")).unionByName(members.select(F.col("a").alias("want"))).distinct()
    texts = cut(texts_of(docs, firsts, wanted.hint("merge"), edits[0][0]))
    late = late_of_pairs(pairs, texts, edits).unionByName(late_of_groups(members, texts, edits, block_chars))
    late = late.select(F.col("id").alias("i"), F.col("check").alias("c")).distinct()
    decided = firsts.join(late, (F.col("id") == F.col("i")) & (F.col("check") == F.col("c")), "left").where("n > 1 OR i IS NOT NULL")
    decided = cut(decided.select(F.col("id").alias("i"), F.col("check").alias("c"), "first", F.col("i").isNotNull().alias("late"), "n"))
    # The occurrences of a frequent line stay where they are and meet it by a broadcast; all others are shuffled.
    frequent, bound = heavy(decided, "n", seen.count())
    same = (F.col("id") == F.col("i")) & (F.col("check") == F.col("c"))
    often = seen.join(F.broadcast(frequent), same)
    others = seen.join(F.broadcast(frequent.select("i", "c")), same, "left_anti").join(decided.where(F.col("n") <= bound), same)
    gone = often.unionByName(others).where(F.col("late") | (F.struct("doc_id", "line") > F.col("first")))
    return gone.groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_set(F.col("line").cast("int")).alias("gone"))


def checked(edits) -> tuple[tuple[int, int], ...]:
    edits = tuple(sorted((int(least), int(t)) for least, t in edits))
    if not edits or any(t < 1 or least < t + 1 for least, t in edits) or any(a[1] >= b[1] for a, b in zip(edits, edits[1:])):
        raise ValueError("edits are pairs (least length, edits): both grow, and a line is longer than its edits")
    return edits


def deduplicate_lines(docs: DataFrame, edits=EDITS, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """docs with text_col replaced by the lines that stay, and lines_col, removed_col added: how many there were, and how many went.

    edits: pairs (least length, edits) that say how far lines of such a length
    may be from an earlier one; below the least only equal lines are repeats.
    Lines are what line feeds part. A line goes if an earlier one, by
    (doc_id, place in the text), is equal or within the edits allowed; lines
    are judged on the input, not on what is left. Blank lines stay. Null texts
    stay null, with no lines; an empty text is one blank line; texts may be of
    any length. Rows with a null id keep all lines and take none from others;
    equal rows don't take lines from each other; lines at one place of
    different texts under one id are not earlier than each other. An empty
    table gives an empty result. Other columns stay as they are, whatever
    their names; only lines_col and removed_col are replaced.
    """
    edits = checked(edits)
    own, tag, of, of_tag, lost = fresh([*docs.columns, lines_col, removed_col], "id", "tag", "of", "of_tag", "gone")
    keyed = docs.drop(lines_col, removed_col).withColumns({own: F.col(id_col).cast("long"), tag: F.xxhash64(text_col)})
    chosen = keyed.where(F.col(own).isNotNull() & F.col(text_col).isNotNull()).select(F.col(own).alias("doc_id"), F.col(tag).alias("tag"), F.col(text_col).alias("text"))
    gone = repeated_lines(chosen, edits, group).toDF(of, of_tag, lost)
    joined = keyed.join(gone, (F.col(own) == F.col(of)) & (F.col(tag) == F.col(of_tag)), "left")
    pieces = F.split(text_col, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(lost))
    kept = let(pieces, lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n"))  # cut once, not for each line
    changed = {lines_col: F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.size(pieces).cast("long")), removed_col: F.coalesce(F.size(lost), F.lit(0)).cast("long"), text_col: F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept)}
    return joined.withColumns(changed).select(*[c for c in docs.columns if c.lower() not in (lines_col.lower(), removed_col.lower())], lines_col, removed_col)
