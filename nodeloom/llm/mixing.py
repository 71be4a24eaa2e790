"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place in its source: 60 bits of a hash of its id. The
words of each source are summed by the leading 15 bits of that place; a
running sum over these buckets finds the one that the source's budget ends in,
and the next 15 bits refine that bucket alone, four times in all. What is
left is one threshold for each source: a document is taken if its place is
below. No sort of documents takes place, and a source with most of the rows
costs as much as any other, since sums are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

BITS, LEVELS = 15, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str) -> Column:
    """60 bits that reruns and other engines find alike; null ids share one place."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target for a row per source (source, source_size).

    Weights go round the sources by code point, null last. Targets are
    min(level * weight, most * source_size), with the level at which they add
    up to share of all words: each prefix of the sources by the level that
    fills them gives one candidate. One task sees one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("most") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = F.max(F.when(F.col("full_at") >= F.col("level"), F.col("level"))).over(everything)
    return ranked.select("source", "source_size", F.least(F.coalesce(level * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source: source, source_size, target, turns, below, rest, rest_size.

    sized: source, size, place. Every document is taken turns times, and once
    more if its place is less than below; those at below share rest words in
    proportion to their sizes, which add up to rest_size.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("turns", turns).withColumn("rest", F.round(F.col("target") - F.col("turns") * F.col("source_size")).cast("long"))
    whole = (F.col("rest") >= F.col("source_size")) & (F.col("source_size") > 0)  # rounded up to a turn, which no bucket ends
    goal = goal.withColumns({"turns": F.col("turns") + whole.cast("long"), "rest": F.when(whole, 0).otherwise(F.col("rest")).cast("long")})
    state = stored(goal.withColumn("below", F.lit(0).cast("long")), "mix")
    inside = sized.where("size > 0").select(F.col("source").alias("s"), "size", "place")
    for level in range(LEVELS):
        step = 1 << BITS * (LEVELS - 1 - level)
        if level:  # only what lies in the boundary buckets
            bound = state.select("source", F.col("below").alias("lo"))
            inside = inside.join(bound, F.col("s").eqNullSafe(F.col("source"))).where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + step * (1 << BITS))).select("s", "size", "place")
            inside = stored(inside, "mix")
        sums = inside.groupBy("s", F.shiftright("place", BITS * (LEVELS - 1 - level)).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("passed", F.coalesce(F.sum("words").over(running), F.lit(0)))
        found = (
            state.select("source", F.col("rest").alias("goal")).join(sums, F.col("s").eqNullSafe(F.col("source")))
            .where((F.col("passed") <= F.col("goal")) & (F.col("goal") < F.col("passed") + F.col("words")))
            .select("s", (F.col("bucket") * step).cast("long").alias("at"), (F.col("goal") - F.col("passed")).alias("left"), "words")
        )
        columns = [c for c in state.columns if c not in ("below", "rest", "rest_size")]
        state = stored(state.join(found, F.col("s").eqNullSafe(F.col("source")), "left").select(*columns, F.coalesce("at", F.lit(0)).cast("long").alias("below"), F.coalesce("left", F.lit(0)).cast("long").alias("rest"), F.coalesce("words", F.lit(0)).cast("long").alias("rest_size")), "mix")
    return state


def with_taken(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """sized with source_size, target and taken; taken adds up to the rounded target in each source, but for ties in place."""
    per_source = per_source.withColumnRenamed("source", "of_source")
    partial = F.when(F.col("rest_size") > 0, F.floor(F.col("rest") * F.col("size") / F.col("rest_size"))).otherwise(0)
    extra = F.when(F.col("place") < F.col("below"), F.col("size")).when(F.col("place") == F.col("below"), partial).otherwise(0)
    return sized.join(per_source, sized["source"].eqNullSafe(per_source["of_source"])).withColumn("taken", (F.col("turns") * F.col("size") + extra).cast("long")).drop("of_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words a mix takes from every document.

    Returns doc_id, source, size, source_size, target, taken for each row.
    Null texts and texts without words have size 0 and give nothing; a null
    source is a source of its own, the last; repeated ids share a place, and
    if the budget ends there, each gives in proportion; an empty table gives
    an empty result. Other columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place(F.col(id_col), seed).alias("place"))
    sized = stored(sized, "mix")
    return with_taken(sized, thresholds(sized, weights, share, most)).select("doc_id", "source", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed table itself: docs' columns, whatever their names, each row as often as the mix takes it.

    Documents stay whole: the one that a budget ends in is taken if at least
    half of it falls within. Rows without words are not taken; a null source is
    one of its own; rows that share an id are taken together, also where the
    budget ends; an empty table gives an empty result.
    """
    columns = docs.columns
    size, at, turn, *names = fresh(columns, "size", "place", "turn", "source", "turns", "below", "rest", "rest_size")
    keyed = docs.withColumns({size: word_count(F.col(text_col)), at: place(F.col(id_col), seed)})
    sized = stored(keyed.select(F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(at).alias("place")), "mix")
    per_source = thresholds(sized, weights, share, most).select("source", "turns", "below", "rest", "rest_size").toDF(*names)
    source, turns, below, rest, rest_size = map(F.col, names)
    joined = keyed.join(per_source, F.col(source_col).eqNullSafe(source)).where(F.col(size) > 0)
    more = (F.col(at) < below) | ((F.col(at) == below) & (rest * 2 >= rest_size) & (rest > 0))
    times = (turns + more.cast("long")).cast("int")
    return joined.where(times > 0).withColumn(turn, F.explode(F.array_repeat(F.lit(0), times))).select(*columns)
