"""The first rows of an order, in all or per key, without sorting: order statistics from histograms.

An order is a number of 64 bits. Its leading bits are counted per key, running
sums over these counts tell the bucket that the last wanted row falls into, and
only rows of that bucket are counted by their next bits. What is left after
the last bits is the exact threshold of each key: rows below it are in, rows
above are out, and no row is ever ranked, so that a key with most of the rows
is spread over tasks like any other. Counts are summed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Where the bits of an order are cut, from the leading ones on: at most 65,536 counts a key and step.
VALUE_STEPS = (48, 32, 16, 0)
#: For orders that are evenly spread over 60 bits: few rows are left after the first step.
DRAW_STEPS = (44, 0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed a single time however often use names it; in a plain expression branches would compute it again."""
    return F.transform(F.array(value), use)[0]


def value_order(value: Column) -> Column:
    """A double as a whole number that has the same order: its bits, those of negative ones counted down from 0. Null stays null; NaN comes last."""

    def bits(v: Column, size: Column) -> Column:
        # The logarithm may be one off where a value is near a power of two.
        near = lambda p: once(size / F.pow(F.lit(2.0), p), lambda q: F.when(q >= 2, p + 1).when(q < 1, p - 1).otherwise(p))
        usual = lambda p: (p + 1023) * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), p) - 1) * F.lit(2.0**52)).cast("long")
        small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
        return F.when(F.isnan(v), F.lit(0x7FF8 << 48)).when(F.abs(v) == float("inf"), F.lit(0x7FF0 << 48)).when(size < 2.0**-1022, small).otherwise(once(once(F.floor(F.log2(size)), near), usual))

    v = value.cast("double")
    size = F.abs(v)
    return once(bits(v, F.when(size < float("inf"), size)), lambda b: F.when(v < 0, -b).otherwise(b))


def draw_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def draw_orders(id_col: str, seed: int) -> list[Column]:
    """The leading 60 bits of draw_order, and the next 60 for ties."""
    h = draw_order(id_col, seed)
    return [F.conv(F.substring(h, at, 15), 16, 10).cast("long") for at in (1, 16)]


def same_key(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def thresholds(rows: DataFrame, order: Column, wanted: Callable[[Column], Column], keys: tuple[str, ...] = (), value: Column | None = None, steps: tuple[int, ...] = VALUE_STEPS) -> DataFrame:
    """Per key, where its first wanted(n) of n rows end: (keys.., __sel_t, __sel_rest, __sel_at, __sel_below, __sel_sum, __sel_value).

    __sel_t is the order of the last of them, __sel_at how many rows have it and
    __sel_rest how many of those are wanted; __sel_below rows come before, whose
    values sum to __sel_sum; __sel_value is the smallest value at __sel_t. If no row is
    wanted, __sel_rest and __sel_below are 0. Rows whose order is null don't count.
    """
    keys = list(keys)
    slim = rows.select(*keys, order.alias("__sel_o"), (F.lit(0.0) if value is None else value).alias("__sel_v")).where("__sel_o IS NOT NULL")
    found, known = None, []
    for i, shift in enumerate(steps):
        lead = F.shiftright("__sel_o", shift)
        if found is None:
            here = slim.withColumn("__sel_lead", lead)
        else:
            there = found.withColumnsRenamed({k: f"__sel_k{j}" for j, k in enumerate(keys)})
            met = slim.join(there, same_key(keys, [f"__sel_k{j}" for j in range(len(keys))]) & (F.shiftright("__sel_o", steps[i - 1]) == F.col("__sel_t")))
            here = met.withColumn("__sel_lead", lead)
            known = ["__sel_rest", "__sel_below", "__sel_sum"]
        counts = here.groupBy(*keys, *known, "__sel_lead").agg(F.count("*").alias("__sel_n"), F.sum("__sel_v").alias("__sel_s"), F.min("__sel_v").alias("__sel_value"))
        own = Window.partitionBy(*keys)
        upto = own.orderBy("__sel_lead").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumns({"__sel_upto": F.sum("__sel_n").over(upto), "__sel_sums": F.sum("__sel_s").over(upto), "__sel_total": F.sum("__sel_n").over(own)})
        if found is None:
            counts = counts.withColumns({"__sel_rest": F.least(wanted(F.col("__sel_total")).cast("long"), F.col("__sel_total")), "__sel_below": F.lit(0).cast("long"), "__sel_sum": F.lit(0.0)})
        first = F.col("__sel_upto") - F.col("__sel_n")
        ends = counts.where(((F.col("__sel_rest") > first) & (F.col("__sel_rest") <= F.col("__sel_upto"))) | ((F.col("__sel_rest") <= 0) & (first == 0)))
        found = ends.select(*keys, F.col("__sel_lead").alias("__sel_t"), F.greatest(F.col("__sel_rest") - first, F.lit(0)).alias("__sel_rest"), F.col("__sel_n").alias("__sel_at"), (F.col("__sel_below") + F.when(F.col("__sel_rest") > 0, first).otherwise(0)).alias("__sel_below"), (F.col("__sel_sum") + F.when(F.col("__sel_rest") > 0, F.col("__sel_sums") - F.col("__sel_s")).otherwise(0.0)).alias("__sel_sum"), "__sel_value")
        if i + 1 < len(steps):
            # Stored, its size is known: a row per key, which the next step's join sends to the rows unless the keys are many.
            found = stored(found.select(*keys, "__sel_t", "__sel_rest", "__sel_below", "__sel_sum"), "step")
    return found


def chosen(df: DataFrame, orders: list[Column], wanted: Callable[[Column], Column], keys: tuple[str, ...] = (), name: str = "chosen", among: Column | None = None, steps: tuple[int, ...] = VALUE_STEPS) -> DataFrame:
    """df with name: whether a row is among the first wanted(n) of the n rows of its key, in the first of the orders; ties are settled by the next order, in the end by all columns.

    among: only rows for which it holds count and can be chosen. Exactly
    wanted(n) rows are chosen, or all if there are fewer; rows whose first
    order is null are not. Of rows that are equal in everything the right
    number is chosen.
    """
    keys_, renamed = list(keys), [f"__sel_key{j}" for j in range(len(keys))]
    taking = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    ends = thresholds(df.where(taking), orders[0], wanted, keys, steps=steps).select(*(F.col(k).alias(r) for k, r in zip(keys_, renamed)), "__sel_t", "__sel_rest", "__sel_at")
    ends = stored(ends, "thresholds")
    columns = [c for c in df.columns if c != name]
    if keys_:
        met = df.join(ends, same_key(keys_, renamed), "left")
        t, rest, there = F.col("__sel_t"), F.col("__sel_rest"), F.col("__sel_at")
    else:
        met, (t, rest, there) = df, map(F.lit, ends.first() or (None, 0, 0))
    below, at = orders[0] < t, orders[0] == t
    if ends.where("__sel_rest > 0 AND __sel_rest < __sel_at").isEmpty():
        return met.withColumn(name, F.coalesce(taking & (below | (at & (rest == there))), F.lit(False))).select(*columns, name)
    tied = F.coalesce(taking & at & (rest > 0) & (rest < there), F.lit(False))
    clear = met.where(~tied).withColumn(name, F.coalesce(taking & (below | (at & (rest == there))), F.lit(False)))
    ties, inner = met.where(tied).withColumn("__sel_want", rest.cast("long")).select(*columns, "__sel_want"), (*keys, "__sel_want")
    settled = chosen(ties, orders[1:], lambda n: F.col("__sel_want"), inner, name, steps=steps) if len(orders) > 1 else dealt(ties, inner, name)
    return clear.select(*columns, name).unionByName(settled.select(*columns, name))


def dealt(rows: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """rows with name: true for __sel_want of them per key. Equal rows are counted, and running sums over the counts deal out what each kind gets."""
    kinds = rows.groupBy(*rows.columns).agg(F.count("*").alias("__sel_n"))
    before = Window.partitionBy(*keys).orderBy(F.xxhash64(*rows.columns)).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("__sel_left", F.col("__sel_want") - F.coalesce(F.sum("__sel_n").over(before), F.lit(0)))
    return kinds.withColumn("__sel_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__sel_n")))).select(*rows.columns, (F.col("__sel_i") <= F.col("__sel_left")).alias(name))
