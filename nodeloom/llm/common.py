"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clear, cut, forget, new_path, shared_dir, stored  # noqa: F401

#: The white space that separates words: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns, *names: str) -> list[str]:
    """names, with underscores added until no column is called so, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def heavy(counts: DataFrame, n: str, total: int, least: int = 4096) -> tuple[DataFrame, int]:
    """(rows of counts whose n is above a bound, the bound): least, or a share of total if that is more. Since n adds up to total at most, there are no more than 4 such rows for each shuffle partition, which bounds a broadcast."""
    bound = max(least, total // (4 * parallelism(counts.sparkSession)))
    return counts.where(F.col(n) > bound), bound


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slices(batches, rows: int = 256, most: int = 4_000_000):
    """Arrow batches of few rows and, unless one row is larger, few bytes, which bounds what a Python worker holds where texts are long."""
    for batch in batches:
        waiting = [batch.slice(start, rows) for start in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.nbytes > most and part.num_rows > 1:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part
    trim()


def trim() -> None:
    """Give memory that a finished task has freed back to the system, since the worker waits on for others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


_held: list = ["", None]


def claim(owner: str, clear) -> None:
    """Called by what remembers things in a worker: those of another owner are dropped first, since workers outlive a query."""
    if _held[0] != owner:
        if _held[1] is not None:
            _held[1]()
        _held[:] = [owner, clear]
