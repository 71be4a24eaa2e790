"""Places in a short sorted list, by bisection inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place_in(bounds: list, x: Column) -> Column:
    """How many of the ascending bounds are at most x, in about log2 of their number steps; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*map(F.lit, bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(table, at + step - 1) <= x, F.lit(False)), step).otherwise(0))
