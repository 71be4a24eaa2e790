"""How filters interact: what each of them removes in every order they could be applied in.

A document is known by the set of filters it fails, five bits. A table of 32
sets by 120 orders holds the step at which such a document goes, so that an
order is never run: each partition looks its documents up and adds them up by
part, order and step, and the partial counts are summed.
"""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
UPPER = bytes(range(65, 91))
SIGNS = re.compile(rb"[#$%&*|]")
CHUNK = 1 << 22


def failed_by_text(text: bytes, n_chars: int) -> int:
    """Which of the filters A to D a text fails, a bit each from the lowest on."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        to = at + CHUNK
        while 0 < to < len(text) and text[to] not in b" \t\n\v\f\r":  # a word isn't cut
            to += 1
        words = (text[at:to] if at or to < len(text) else text).split()
        n += len(words)
        distinct.update(words)
        at = to
    upper = len(text) - len(text.translate(None, UPPER))
    return (n < FEW_WORDS) | (100 * len(distinct) < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * n_chars) << 2 | bool(SIGNS.search(text)) << 3


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, failed (the filters A to D that the text fails, as bits) and digest (128 bits that tell texts apart) of every row."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in slices(batches):
            text = pc.fill_null(batch.column("text"), "")
            data = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_pylist()
            failed = [failed_by_text(b, n) for b, n in zip(data, pc.utf8_length(text).to_pylist())]
            digests = [hashlib.blake2b(b, digest_size=16).digest() for b in data]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "failed", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, failed int, digest binary")


def with_repeats(rows: DataFrame) -> DataFrame:
    """part, failed (with the bit of E), good, toxic, n: how many documents, equal texts told apart by the smallest doc_id.

    Rows are summed before each shuffle that gathers a text's copies, so that
    a text copied into most rows is a row per part and label after the first.
    """
    each = rows.groupBy("digest", "part", "failed", "good", "toxic", "doc_id").agg(F.count("*").alias("n"))
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    classes = each.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.min(first).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = classes.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.count("*").alias("several"), F.max("n").alias("most")).where("several > 1 OR most > 1")
    met = classes.join(least, "digest", "left")
    own = F.when(F.col("least").isNull(), F.col("n")).otherwise(F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0))
    split = met.withColumn("own", own).select("part", "good", "toxic", F.explode(F.array(F.struct("failed", F.col("own").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("own")).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.failed").alias("failed"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def first_failures():
    """The step, from 0 on, at which a document that fails a set of filters goes in an order, 5 if in none: 32 rows of 120."""
    import numpy as np

    places = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
    sets = np.arange(32)[:, None, None] >> np.arange(5) & 1
    return np.where(sets == 1, places[None], 5).min(2)


def added_up(failed, n, good, toxic):
    """COUNTS of the documents of one part, as an array of 120 orders by 5 steps each: failed tells their sets, n how many of each, good and toxic whether they carry the label."""
    import numpy as np

    cells = (np.arange(120) * 6 + first_failures()[failed]).ravel()

    def gone(weights):
        return np.bincount(cells, np.repeat(weights, 120), 720).reshape(120, 6)[:, :5].astype(np.int64)

    sets = np.bincount(failed, n, 32).astype(np.int64)
    letters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    removed = gone(n)
    fails = (sets[:, None] * (np.arange(32)[:, None] >> np.arange(5) & 1)).sum(0)
    shapley = np.bincount(letters.ravel(), removed.ravel(), 5).astype(np.int64)
    kept = sets.sum() - removed.cumsum(1)
    return kept, removed, fails[letters] - removed, sets[1 << np.arange(5)][letters], gone(n * good), gone(n * toxic), shapley[letters]


def interactions(sets: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS from rows of part, failed, good, toxic and n."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        orders, steps = pa.array(np.repeat(ORDERS, 5)), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), 120))
        for batch in batches:
            parts, place = np.unique(np.array(batch.column("part").to_pylist(), object), return_inverse=True) if batch.num_rows else ([], [])
            failed, n, good, toxic = (np.asarray(batch.column(c)).astype(np.int64) for c in ("failed", "n", "good", "toxic"))
            for i, part in enumerate(parts):
                own = place == i
                counts = added_up(failed[own], n[own], good[own], toxic[own])
                yield pa.RecordBatch.from_arrays([pa.array([part] * 600, pa.string()), orders, steps, *(pa.array(c.ravel(), pa.int64()) for c in counts)], names=["part", "filter_order", "step", *COUNTS])

    partial = sets.repartition("part").mapInArrow(run, schema)  # at most 128 rows a part
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))


def has_label(c: str) -> Column:
    return F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step and COUNTS.

    A document fails A with fewer than 50 words, B if less than 65 % of its
    words are distinct, C if more than 5 % of its code points are A-Z, D if it
    holds any of #$%&*|, and E if a row with a smaller id has the same text,
    in any part. Null texts are empty ones, null parts are the part ''. A row
    without an id repeats nothing and is repeated by nothing; equal ids with
    equal texts don't repeat one another. Several labels of one id count if
    one of them does; documents without labels count as neither. Texts may be
    of any length, other columns play no part, and an empty table gives no
    rows. Two texts are the same if 128 bits of BLAKE2b are. Counts are exact
    below 2^53 documents.
    """
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has_label("quality").alias("good"), has_label("toxic").alias("toxic"))
    rows = judged(docs, id_col, text_col, part_col).join(marked, "doc_id", "left").fillna(0, ["good", "toxic"])
    return interactions(with_repeats(rows))
