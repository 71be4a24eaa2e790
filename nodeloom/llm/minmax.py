"""Near-duplicate documents by min-max hashing.

Under each permutation of the shingle hashes both the smallest and the largest
value are kept: each of them agrees between two sets with a probability equal
to their Jaccard similarity, so that half the permutations give as many
values, and the estimate from both has a lower variance. Six values make a
band; documents that share a band are candidates.

Equal sets are one class from the start. The others are compared on their full
shingle sets in two steps. First each member of a bucket meets the bucket's
smallest one, its hub, once for all bands; a hub of very many is copied to several tasks, which share them. What these links
join needs no more comparing. Then only buckets are left in which members other
than the hub are still apart: these are compared block by block. A block holds
up to 256 members, two blocks meet in one task, and only a spanning forest of
the links between different components is returned. So no pairs of a group are
listed, no task holds more than two blocks, no link between candidates is
lost, and documents that are only weakly alike cost what the buckets cost that
they really share: they chain nothing together.

A pair at similarity 0.8 shares no band out of 40 with probability 5e-6; at
0.85 it is below 1e-8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import cut, heavy, parallelism, slices, stored
from .tokens import hashed, mixed, shingle_set

BANDS, ROWS, BLOCK = 40, 6, 256


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return draw.integers(0, top, count, np.uint64, endpoint=True), draw.integers(0, top, count, np.uint64, endpoint=True) | np.uint64(1)


def signatures(sets: list[np.ndarray], count: int, seed: int = 1) -> np.ndarray:
    """A row per non-empty set: minimum and maximum under each of count permutations, in turn."""
    out = np.empty((len(sets), 2 * count), np.uint64)
    if not sets:
        return out
    values, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    for i, (flip, factor) in enumerate(zip(*permutations(count, seed))):
        permuted = (values ^ flip) * factor
        out[:, 2 * i] = np.minimum.reduceat(permuted, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(permuted, starts)
    return out


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per set and band; the band's number is part of it."""
    keys = np.empty((len(signed), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signed), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, r])
        keys[:, b] = key
    return keys


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits of the whole set), bands of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in slices(batches):
            sets = [shingle_set(h, words) for h in hashed([x or "" for x in batch.column("text").to_pylist()], lower=True)]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full, bands * rows // 2), bands, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=SKETCH.names,
            )

    return docs.mapInArrow(run, SKETCH)


def linked_forest(sets: list[np.ndarray], percent: int, split: int | None = None, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that join the same sets as all links with 100 * intersection >= percent * union.

    split: only links between the first split sets and the others count.
    apart: a number per set; only links between different numbers count.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1  # others meet in no pair
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
        lo, hi = np.searchsorted(column, (start, start + 8192))
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        common += part @ part.T
    inter = common.astype(np.int64)
    linked = np.triu(100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter), 1)
    if split is not None:
        linked[:split, :split] = linked[split:, split:] = False
    if apart is not None:
        linked &= apart[:, None] != apart[None, :]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    forest = []
    for a, b in zip(*np.nonzero(linked)):
        ra, rb = root(int(a)), root(int(b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            forest.append((int(a), int(b)))
    return forest


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = common_count(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


LINK = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _links(pairs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*pairs) if pairs else ([], []))], names=LINK.names)


def members_of(classes: DataFrame) -> DataFrame:
    """(key, node, hub) of all buckets with two nodes or more: hub is the smallest."""
    entries = classes.select("node", F.explode("bands").alias("key"))
    hubs = entries.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other")
    return entries.join(hubs, F.col("key") == F.col("k")).select("key", "node", "hub")


def shingles_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the full sets of docs (doc_id, text) that are among nodes."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = pa.array([shingle_set(h, words).tobytes() for h in hashed([x or "" for x in batch.column("text").to_pylist()], lower=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=schema.names)

    return docs.join(nodes.select("node"), F.col("doc_id") == F.col("node")).select("node", "text").mapInArrow(run, schema)


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): which of the pairs (node, hub) are links on their full sets (node, shingles)."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("hub").count()
    frequent, bound = heavy(counts, "count", pairs.count(), 512)
    copies = frequent.select(F.col("hub").alias("h"), F.ceil(F.col("count") / bound).cast("int").alias("copies"))
    dealt = lambda df: df.join(F.broadcast(copies), F.col("hub") == F.col("h"), "left").withColumn("copies", F.coalesce("copies", F.lit(1))).drop("h")
    hubs = dealt(pairs.select("hub").distinct()).join(sets, F.col("hub") == F.col("node"))
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("member"), "node", "shingles")
    members = dealt(pairs).join(sets, "node").select("hub", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"), F.lit(True).alias("member"), "node", "shingles")
    placed = hubs.unionByName(members).repartition(parallelism(spark), "hub", "copy").sortWithinPartitions("hub", "copy", "member")

    def run(batches):
        key, own = None, []
        for batch in slices(batches, 1024):
            out = []
            for hub, copy, member, node, shingles in zip(*(batch.column(c).to_pylist() for c in ("hub", "copy", "member", "node", "shingles"))):
                if (hub, copy) != key:
                    key, own = (hub, copy), []
                a = np.frombuffer(shingles, np.uint64)
                if not member:
                    own.append(a)
                elif any(linked(a, b, percent) for b in own):
                    out.append((hub, node))
            yield _links(out)

    return placed.mapInArrow(run, LINK)


def open_buckets(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, node, comp, n): members other than the hub of the buckets in which these are not one component; buckets with the same members count once."""
    comp = F.coalesce("component", "m").alias("comp")
    rows = members.where("node <> hub").select("key", F.col("node").alias("m")).join(joined, F.col("m") == F.col("node"), "left").select("key", F.col("m").alias("node"), comp)
    marks = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    left = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), *marks).where("low < high")
    left = left.groupBy("n", "x", "y").agg(F.min("key").alias("k")).select("k", "n")
    return rows.join(left, F.col("key") == F.col("k")).select("key", "node", "comp", "n")


def block_links(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(u, v): links on full sets that join what all links between different components in a bucket join. rows: of open_buckets()."""
    placed = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).join(sets, "node")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j")))
    columns = ["key", "i", "j", "own", "node", "comp", "shingles"]
    placed = placed.withColumn("at", F.explode(meetings)).select("key", "at.i", "at.j", *columns[3:])
    placed = placed.repartition(parallelism(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "node")

    def run(batches):
        def links(key, held):
            sets, nodes = [np.frombuffer(s, np.uint64) for *_, s in held], [n for _, n, _, _ in held]
            split = sum(own == key[1] for own, *_ in held) if key[1] != key[2] else None
            return [(nodes[a], nodes[b]) for a, b in linked_forest(sets, percent, split, np.array([c for _, _, c, _ in held]))]

        key, held = None, []
        for batch in slices(batches, 1024):
            out = []
            for *k, own, node, comp, shingles in zip(*(batch.column(c).to_pylist() for c in columns)):
                if k != key:
                    out += links(key, held) if len(held) > 1 else []
                    key, held = k, []
                held.append((own, node, comp, shingles))
            yield _links(out)
        if len(held) > 1:
            yield _links(links(key, held))

    return placed.mapInArrow(run, LINK)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents that links of percent or more join.

    Words are lower-cased in A-Z and cut at ASCII white space; a text with
    fewer than words of them has one shingle of all; null texts and those
    without words have none and are linked with nothing; texts may be of any
    length. component_id is the smallest doc_id that links reach, kept is true
    where it is the row's own. Repeated rows each get the same result; texts
    under one repeated id count as linked; rows whose id is null are linked
    with nothing and kept; an empty table gives an empty result. Other columns
    are ignored, whatever their names. Shingles are 64-bit hashes: two sets of
    a thousand each share one by chance with a probability of 5e-14; equal
    sets are told by 128 bits.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = stored(sketches(chosen, words, bands, rows), "minmax")
    named = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(named.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "minmax")
    members = stored(members_of(classes), "minmax")
    sets = stored(shingles_of(chosen.where("doc_id IS NOT NULL"), members.select("node").distinct(), words), "minmax")
    pairs = cut(members.where("node <> hub").select("node", "hub").distinct())
    links = cut(hub_links(pairs, sets, percent))
    left = cut(open_buckets(members, connected_components(links, cut)))
    # Texts under one id are one node; a class also joins all ids that it has, through its smallest.
    repeated = named.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).where("a <> b").select("doc_id")
    same_id = named.join(repeated, "doc_id").join(classes.select("set_hash", "node"), "set_hash").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    joined = connected_components(links.unionByName(block_links(left, sets, percent, block)).unionByName(same_id), cut)
    reached = classes.select("set_hash", "node").join(joined.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    out = known.join(reached, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
