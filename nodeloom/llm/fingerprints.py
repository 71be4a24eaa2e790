"""Document fingerprints: one-permutation MinHash with optimal densification.

Each shingle of five words is hashed once. The leading bits of the hash choose
a bin and the smallest hash of a bin is kept; a bin that no shingle fell into
takes the value of a filled bin, drawn for each empty bin independently of the
others (the filled bin that wins a fixed hash of both numbers, so that equal
sets of filled bins draw alike). Only the low-order bits of each value are
stored; chance agreement of these is taken out of the likeness.

All of it is expressions over arrays: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.search import place_in
from .common import WORD, let, parallelism, sha256_of

WORDS, BINS, BITS = 5, 128, 8


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A 63-bit hash per shingle; texts with fewer words have one of all their words, those without words none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    positive = lambda h: h.bitwiseAND(F.lit(2**63 - 1))

    def rolled(h: Column) -> Column:
        n = F.size(h)
        one = F.array(positive(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))), lambda i: positive(F.xxhash64(*(F.element_at(h, i + F.lit(j)) for j in range(words)))))
        return F.when(n >= words, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(found, rolled)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> Column:
    """array<int> with the low-order bits of each bin; empty for a text without words. bins: a power of 2."""
    shift = 63 - (bins.bit_length() - 1)
    bin_of = lambda x: F.shiftright(x, shift).cast("int")
    low = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def smallest(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))

    def drawn(b: Column, least: Column) -> Column:
        chances = F.transform(least, lambda x, i: F.xxhash64(b, bin_of(x)).bitwiseAND(F.lit(-bins)).bitwiseOR(i.cast("long")))
        return F.get(least, F.array_max(chances).bitwiseAND(F.lit(bins - 1).cast("long")).cast("int"))

    def dense(least: Column) -> Column:
        filled = F.map_from_arrays(F.transform(least, bin_of), least)
        each = let(filled, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: low(F.coalesce(F.try_element_at(m, b), drawn(b, least)))))
        full = F.transform(least, low)
        return F.when(F.size(least) == bins, full).when(F.size(least) == 0, F.array().cast("array<int>")).otherwise(each)

    return let(let(F.sort_array(shingle_hashes(F.coalesce(text, F.lit("")), words)), smallest), dense)


def packed(values: Column, bits: int = BITS) -> Column:
    """The values one after another, in hexadecimal digits of four bits each. bits: a multiple of 4."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), bits // 4, "0")), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of what two fingerprints stand for, corrected for bits that agree by chance. Two empty ones: 1; an empty one and another: 0."""
    chance = 0.5**bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.greatest(F.size(a), F.lit(1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_next(rows: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """rows (doc_id and others) with next_<column>, the value in the row that follows in descending doc_id; the first follows the last.

    Rows of one id are ordered by a hash of the column tie, which the others
    follow from; null ids come last.
    Quantiles of the ids cut the rows into ranges of about equal numbers, and
    the first row of a range also goes to the range whose last row it follows.
    Collected are a bound and a first row's id for each range.
    """
    spark = rows.sparkSession
    count = 4 * parallelism(spark)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20 * count)).first()[0] or []
    bounds = sorted(set(bounds))
    keyed = rows.withColumn("part", place_in(bounds, F.col("doc_id"))).withColumn("tie", F.xxhash64(tie))
    key = F.struct(F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("tie").alias("t"))
    firsts = {r["part"]: r["first"] for r in keyed.groupBy("part").agg(F.max(key).alias("first")).collect()}
    there = sorted(firsts)
    hosts = [(p, there[(i + 1) % len(there)], firsts[p]["i"], firsts[p]["t"], firsts[p]["k"]) for i, p in enumerate(there)]
    guests = spark.createDataFrame(hosts, "g_part int, host int, g_id long, g_tie long, g_there boolean")
    is_first = (F.col("g_tie") == F.col("tie")) & (F.col("g_there") == F.col("doc_id").isNotNull()) & (F.col("g_id") == F.coalesce("doc_id", F.lit(0)))
    placed = keyed.join(F.broadcast(guests), F.col("part") == F.col("g_part"))  # a row per range
    here = F.struct(F.col("part").alias("p"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("p"), F.lit(True).alias("guest"))
    placed = placed.withColumn("at", F.explode(F.when(is_first, F.array(here, visit)).otherwise(F.array(here))))
    from pyspark.sql import Window

    order = Window.partitionBy("at.p").orderBy("at.guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    led = placed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where("NOT at.guest").drop("part", "tie", "g_part", "host", "g_id", "g_tie", "g_there", "at")


def edited(text: Column, following: Column) -> Column:
    """text with its last half, rounded down, replaced by as many characters of the start of following, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, values (array<int>) and fingerprint (packed) of every row.

    Null texts are empty; a text without words has the empty fingerprint;
    equal texts have equal ones. Other columns are ignored.
    """
    chosen = docs.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.withColumn("values", fingerprint(F.col("text"), bins, bits, words)).withColumn("fingerprint", packed(F.col("values"), bits))


def edit_study(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document beside those of its edited text and of the document that follows it in descending doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A table of one row is followed by itself; an empty
    table gives no rows.
    """
    own = fingerprints(docs).drop("fingerprint")
    both = with_next(own, ["text", "values"], "text").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = both.withColumn("edited_values", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), sha256_of(F.col("edited")).alias("edited_sha256"),
        packed(F.col("values")).alias("fingerprint"), packed(F.col("edited_values")).alias("edited_fingerprint"),
        likeness(F.col("values"), F.col("edited_values")).alias("near_edited"), likeness(F.col("values"), F.col("next_values")).alias("near_next"),
    )
