"""Collocations: phrases whose words occur together more often than their parts suggest.

Phrases are named level by level. A word that occurs often has a name; a
phrase of k words is a pair of names, of its first and of its last k - 1
words, and pairs that occur often get a name in turn. Texts are dealt into
shards, sequences of places that each hold the name of the phrase that starts
there. A shard counts its pairs, the counts meet by pair in all of Spark, and
names go back to the shards that hold the pair. So what is shuffled are
distinct pairs of shards, and shards as arrays; and since the two names of a
pair point to its parts, the counts of every cut of a phrase, and what longer
phrases say of it, come from joins of phrases alone.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, parallelism, slices, stored

#: Words of a shard: what is held in a Python worker at a time. A shard's words and pairs are numbered in 23 bits.
SHARD = 1 << 22
BITS = 23
#: What ends a piece becomes a byte that no UTF-8 text has.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\v\f\r", bytes(range(97, 123)) + b"\xff" * 10)
CHUNK = 1 << 20


def word_chunks(text: bytes):
    """Lists of the words of a text, A-Z as a-z, b'\\xff' between its pieces; some half a million words at a time at most."""
    at = 0
    while at < len(text):
        to = at + CHUNK
        while 0 < to < len(text) and text[to] not in b" \t.,;:!?\n\v\f\r":
            to += 1
        yield text[at:to].translate(FOLD).replace(b"\xff", b" \xff ").split()
        at = to


def packed(numbers) -> bytes:
    """32-bit numbers, all first bytes before all second ones and so on, compressed: most of the upper bytes are the same."""
    import numpy as np
    import zstandard

    return zstandard.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Shard:
    """Places filled with numbers of words, from 1 on by order of appearance; 0 between pieces. After a text that goes on in the next shard come its next words, as negative numbers: they complete phrases, but start none that counts."""

    def __init__(self):
        self.numbers = count(1).__next__
        self.langs: dict[str, dict[bytes, int]] = {}
        self.places: list = []
        self.size = 0

    def add(self, lang: str, words: list[bytes], sign: int = 1) -> None:
        import numpy as np

        known = self.langs.get(lang)
        if known is None:
            known = self.langs[lang] = Numbered(self.numbers)
        self.places.append(sign * np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def end(self) -> None:
        import numpy as np

        self.places.append(np.zeros(1, np.int32))
        self.size += 1

    def row(self, number: int) -> tuple:
        import numpy as np

        places = np.concatenate(self.places)
        words = sorted((n, lang, word) for lang, known in self.langs.items() for word, n in known.items() if n)
        counts = np.bincount(places[places > 0], minlength=len(words) + 1)[1:]
        return number, packed(places), [x[1] for x in words], [x[2].decode() for x in words], counts.tolist()


class Numbered(dict):
    def __init__(self, number):
        super().__init__({b"\xff": 0})
        self.number = number

    def __missing__(self, word):
        self[word] = n = self.number()
        return n


def sharded(docs: DataFrame, shard_words: int, ahead: int) -> DataFrame:
    """shard, places, and the lang, word and count of every number that places has. ahead: how many of a text's next words end a shard."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kind = pa.schema([("shard", pa.int64()), ("places", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
        number, shard = TaskContext.get().partitionId(), Shard()

        def given(full):
            nonlocal number
            number += 1 << 22  # above the number of the task
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(full.row(number - (1 << 22)), kind)], schema=kind)

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                waiting: list[list] = []  # full shards, and how many of the next words they lack
                for words in word_chunks(text.encode()):
                    for at in range(0, len(words), shard_words):
                        part = words[at : at + shard_words]
                        for x in waiting:
                            x[0].add(lang, part[: x[1]], -1)
                            x[1] -= len(part[: x[1]])
                        if shard.size and shard.size + len(part) > shard_words:
                            waiting.append([shard, ahead - len(part[:ahead])])
                            shard.add(lang, part[:ahead], -1)
                            shard = Shard()
                        shard.add(lang, part)
                        yield from (given(x[0]) for x in waiting if not x[1])
                        waiting = [x for x in waiting if x[1]]
                yield from (given(x[0]) for x in waiting)
                shard.end()
        if shard.size:
            yield given(shard)

    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, "shard long, places binary, langs array<string>, words array<string>, counts array<long>")


def pairs_of(places):
    """(the places where a pair of names starts, whether it counts, the pair as one number): pairs of neighbors that both have a name."""
    import numpy as np

    at = np.flatnonzero((places[:-1] != 0) & (places[1:] != 0))
    first, second = places[at], places[at + 1]
    return at, first > 0, np.abs(first).astype(np.int64) << 32 | np.abs(second).astype(np.int64)


def counted_pairs(shards: DataFrame) -> DataFrame:
    """shard, a, b, n: the distinct pairs of a shard, as two names, and how often each counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 1):
            shard, places = batch.column("shard").to_pylist()[0], unpacked(batch.column("places").to_pylist()[0])
            names = np.frombuffer(batch.column("names").to_pylist()[0], np.int64)
            _, counts, keys = pairs_of(places)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            n = np.add.reduceat(counts.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
            keys = keys[first]
            for s in range(0, len(keys), 1 << 16):
                part = keys[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(part), shard, np.int64), names[part >> 32], names[part & 0xFFFFFFFF], n[s : s + (1 << 16)])], names=["shard", "a", "b", "n"])

    return shards.select("shard", "places", "names").mapInArrow(run, "shard long, a long, b long, n long")


#: Rows of a task that are sorted by shard at a time.
SENT_ROWS = 1 << 20


def frequent(rows: DataFrame, by: list[str], place: str, least: int) -> DataFrame:
    """The groups of rows that share the columns by and whose n adds up to f >= least: (by.., name, f), and for each shard (shard, data), the names of what it holds.

    rows have a place, the number of a shard or, with by of text, the code of
    a word in its shard. data: 64-bit numbers, compressed, the places of words
    or both names of pairs, and then their own names. A group has a row for
    each shard that holds it, since shards have counted before. Its rows
    follow one another, so that a name is the number of the group in its task,
    by task. Small numbers make small shuffles.
    """
    spread = 4 * parallelism(rows.sparkSession)
    found = rows.withColumn("f", F.sum("n").over(Window.partitionBy(*by))).where(F.col("f") >= least).select(place, *by, "f")
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}

    def number(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard
        from pyspark import TaskContext

        task, count, last = TaskContext.get().partitionId(), 0, None
        if task >= spread:
            raise RuntimeError("more tasks than names have been set apart for")
        types = {"string": pa.string(), "bigint": pa.int64()}
        kind = pa.schema([("shard", pa.int64()), ("data", pa.binary()), *((c, types[kinds[c]]) for c in by), ("name", pa.int64()), ("f", pa.int64())])
        waiting: list = []

        def sent():
            shard, numbers = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting], axis=1)
            order = np.argsort(shard, kind="stable")
            shard, numbers = shard[order], numbers[:, order]
            first = np.flatnonzero(np.diff(shard, prepend=-1))
            data = [zstandard.compress(np.ascontiguousarray(x).tobytes(), 1) for x in np.split(numbers, first[1:], axis=1)]
            return pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(data, pa.binary()), *(pa.nulls(len(first), f.type) for f in list(kind)[2:])], schema=kind)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in by]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([np.asarray(pc.not_equal(k[1:], k[:-1])) for k in keys], axis=0)
            new[0] = last != tuple(k[0].as_py() for k in keys)
            last = tuple(k[-1].as_py() for k in keys)
            names = (count + new.cumsum() - 1) * spread + task
            count += int(new.sum())
            at, own = np.asarray(batch.column(place)), pa.array(np.flatnonzero(new))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary()), *(k.take(own) for k in keys), pa.array(names[new]), batch.column("f").take(own)], schema=kind)
            waiting.append((at >> BITS, np.stack([at & ((1 << BITS) - 1), names])) if place == "code" else (at, np.stack([*map(np.asarray, keys), names])))
            if sum(len(w[0]) for w in waiting) >= SENT_ROWS:
                yield sent()
                waiting.clear()
        if waiting:
            yield sent()

    return found.mapInArrow(number, "shard long, data binary, " + ", ".join(f"{c} {kinds[c]}" for c in by) + ", name long, f long")


def renamed(shards: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Shards of places named by phrases of k words: of those of the level before and the frequent rows of this one. names holds the names of a shard in order, the place of each its number there; number 0 is none."""

    def rename(left, right):
        import numpy as np
        import pyarrow as pa

        import zstandard

        shard = left.column("shard").to_pylist()
        kind = pa.schema([("shard", pa.int64()), ("places", pa.binary()), ("names", pa.binary())])
        if not shard or not right.num_rows:
            return kind.empty_table()
        old = unpacked(left.column("places").to_pylist()[0])
        *keys, names = np.concatenate([np.frombuffer(zstandard.decompress(d), np.int64).reshape(2 if k == 1 else 3, -1) for d in right.column("data").to_pylist()], axis=1)
        order = np.argsort(names)
        names = np.append(np.int64(0), names[order])
        if k == 1:
            at = keys[0][order] + 1
            number = np.zeros(max(int(np.abs(old).max()), int(at.max())) + 1, np.int32)
            number[at] = np.arange(1, len(at) + 1)
            new = np.sign(old) * number[np.abs(old)]
        else:
            known = np.frombuffer(left.column("names").to_pylist()[0], np.int64)[1:]
            a, b = (np.searchsorted(known, x[order]).astype(np.int64) + 1 for x in keys)
            keys = a << 32 | b
            sort = np.argsort(keys)
            at, counts, pairs = pairs_of(old)
            place = np.minimum(np.searchsorted(keys[sort], pairs), len(keys) - 1)
            number = np.where(keys[sort][place] == pairs, sort[place] + 1, 0).astype(np.int32)
            new = np.zeros(len(old), np.int32)
            new[at] = np.where(counts, number, -number)
            filled = new != 0
            near = filled.copy()
            near[1:] |= filled[:-1]  # of places without a name, one after each run is enough
            new = new[near]
        return pa.Table.from_arrays([pa.array(shard), pa.array([packed(new)]), pa.array([names.tobytes()])], schema=kind)

    own = found.where("shard IS NOT NULL").select("shard", "data")
    shards = shards.select("shard", "places") if k == 1 else shards
    return shards.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(rename, "shard long, places binary, names binary")


def wide(c: str):
    return F.col(c).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int | None = 2000, covered_percent: int = 80, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first top phrases of each language by score, a and the bytes of the phrase; of all without top.

    Texts, A-Z as a-z, are cut into pieces at .,;:!? and line ends and these
    into words at spaces and tabs; n counts the words of a language. Phrases
    of 2 to longest words that occur a >= least times within pieces are
    candidates. Of the ways to cut one in two, the one with the smallest
    floor(2000000 * a / (l + r)) counts, l and r being how often the two parts
    occur, and of equal ones the one after the fewest words. A phrase goes if
    a longer candidate that holds its words occurs at least covered_percent
    times in a hundred as often.

    Null texts have no words; a null language is 'und'. Texts, pieces and
    words may be of any length; equal rows all count; an empty table gives no
    rows; other columns play no part.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    shards = stored(sharded(texts, min(shard_words, SHARD), longest - 1), "phrases-shards")
    words = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("at", "w")).select((F.shiftleft("shard", BITS) + F.col("at")).alias("code"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = stored(shards.select(F.explode(F.arrays_zip("langs", "counts")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.counts").alias("n")), "phrases-totals")
    found = stored(frequent(words, ["lang", "word"], "code", least), "phrases-1")
    none = F.array().cast("array<long>")
    level = stored(found.where("f IS NOT NULL").select("name", "lang", "f", F.array("word").alias("words"), none.alias("before"), none.alias("after")), "phrases-level-1")
    levels = []
    for k in range(2, longest + 1):
        old, shards = (shards, found), stored(renamed(shards, found, k - 1), f"phrases-places-{k - 1}")
        for done in old:
            forget(done)
        found = stored(frequent(counted_pairs(shards), ["a", "b"], "shard", least), f"phrases-{k}")
        pairs = found.where("f IS NOT NULL").select("name", "a", "b", "f")
        head = level.select(F.col("name").alias("a"), "lang", F.col("f").alias("f_a"), F.col("words").alias("head"), "before")
        tail = level.select(F.col("name").alias("b"), F.col("f").alias("f_b"), F.element_at("words", -1).alias("last"), "after")
        met = pairs.join(head, "a").join(tail, "b")
        level = stored(met.select("name", "a", "b", "lang", "f", F.concat("head", F.array("last")).alias("words"), F.concat("before", F.array("f_a")).alias("before"), F.concat(F.array("f_b"), "after").alias("after")), f"phrases-level-{k}")
        levels.append(level)
    for done in (shards, found):
        forget(done)
    kept = None
    for own, longer in zip(levels, [*levels[1:], None]):
        if longer is not None:
            over = longer.select(F.explode(F.array("a", "b")).alias("name"), "f").groupBy("name").agg(F.max("f").alias("over"))
            own = own.join(over, "name", "left").where(F.col("over").isNull() | (wide("over") * 100 < wide("f") * covered_percent))
        own = own.select("lang", "f", "words", "before", "after")
        kept = own if kept is None else kept.unionByName(own)
    score = F.expr("transform(before, (x, i) -> struct((2000000 * cast(f AS decimal(31,0))) DIV (cast(x AS decimal(20,0)) + cast(after[i] AS decimal(20,0))) AS score, i AS i))")
    best = kept.withColumn("best", F.array_min(score))
    scored = best.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.get("before", F.col("best.i")).alias("l"), F.get("after", F.col("best.i")).alias("r"), F.col("best.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
