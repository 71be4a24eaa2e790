"""Windows over a run's epochs: early stopping, best epochs, times, and the worst rows of a loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import place_in
from ..storage import stored
from .selection import thresholds, value_order


def early_stop(epochs: DataFrame, most: int, tolerance: float, keys: tuple[str, ...] = ("run_id",), order: str = "epoch", loss: str = "loss_valid") -> DataFrame:
    """epochs with delta, mean_delta and mean_loss over the last most epochs, and stop: whether the mean change is within tolerance."""
    run = Window.partitionBy(*keys).orderBy(order)
    last = run.rowsBetween(-(most - 1), 0)
    out = epochs.withColumn("delta", F.abs(F.col(loss) - F.lag(loss).over(run)))
    out = out.withColumn("mean_delta", F.avg("delta").over(last)).withColumn("mean_loss", F.avg(loss).over(last)).withColumn("seen", F.count("delta").over(last))
    return out.withColumn("stop", (F.col("seen") >= most) & (F.col("mean_delta") <= tolerance)).drop("seen")


def best_epochs(epochs: DataFrame, keys: tuple[str, ...] = ("run_id",), order: str = "epoch", loss: str = "loss_valid") -> DataFrame:
    """epochs with best_before and improved: the lowest loss so far, and whether this one is lower."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = epochs.withColumn("best_before", F.min(loss).over(before))
    return out.withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def checkpoints(epochs: DataFrame, keys: tuple[str, ...] = ("run_id",), order: str = "epoch") -> DataFrame:
    """epochs with saved: whether both losses are lower than their best, where the best validation loss only moves in epochs whose training loss improves."""
    both = F.array_sort(F.collect_list(F.struct(order, "loss_train", "loss_valid")))
    inf = F.lit(float("inf"))

    def step(s: Column, e: Column) -> Column:
        train = e["loss_train"] < s["train"]
        valid = train & (e["loss_valid"] < s["valid"])
        done = F.concat(s["done"], F.array(F.struct(e[order].alias(order), valid.alias("saved"))))
        return F.struct(F.when(train, e["loss_train"]).otherwise(s["train"]).alias("train"), F.when(valid, e["loss_valid"]).otherwise(s["valid"]).alias("valid"), done.alias("done"))

    kind = epochs.schema[order].dataType.simpleString()
    start = F.struct(inf.alias("train"), inf.alias("valid"), F.array().cast(f"array<struct<{order}:{kind},saved:boolean>>").alias("done"))
    folded = epochs.groupBy(*keys).agg(F.aggregate(both, start, step, lambda s: s["done"]).alias("d"))
    return epochs.join(folded.select(*keys, F.inline("d")), [*keys, order])


def mean_time(epochs: DataFrame, keys: tuple[str, ...] = ("run_id",), order: str = "epoch", seconds: str = "seconds") -> DataFrame:
    """epochs with mean_seconds so far."""
    return epochs.withColumn("mean_seconds", F.avg(seconds).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def reshuffles(epoch: Column, every: int) -> Column:
    """Whether batches are dealt anew before an epoch."""
    return (epoch % every == 0) & (epoch > 0)


def running_total(rows: DataFrame, value: str, keys: tuple[str, ...], order: str, name: str = "upto") -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def running_sum(rows: DataFrame, value: str, order: str, name: str = "upto", ranges: int = 200) -> DataFrame:
    """rows with name: the sum of value up to and with each row by a number order, ties by nothing else: equal places share no order.

    In two levels, so that no task sorts the table: quantiles cut it into
    ranges of about equal numbers, each is summed up by itself, and one row per
    range carries on what came before.
    """
    bounds = sorted(set(rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    cut = rows.withColumn("__range", place_in(bounds, F.col(order)))
    sums = cut.groupBy("__range").agg(F.sum(value).alias("__sum"))  # one row per range
    before = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))
    inner = running_total(cut, value, ("__range",), order, name).join(F.broadcast(before), "__range")
    return inner.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def worst_share_loss(rows: DataFrame, share: float, keys: tuple[str, ...] = (), predicted: str = "pred", wanted: str = "y", legacy: bool = False) -> DataFrame:
    """(keys.., loss): the mean squared error of the share of rows with the largest target less prediction, the number rounded up. legacy: of all rows. Null differences don't count."""
    diff = F.col(wanted) - F.col(predicted)
    if legacy:
        return rows.groupBy(*keys).agg(F.avg(diff * diff).alias("loss"))
    slim = stored(rows.select(*keys, diff.alias("d")), "differences")
    ends = thresholds(slim, value_order(-F.col("d")), lambda n: F.ceil(n * share), keys, F.col("d") * F.col("d"))
    return ends.select(*keys, ((F.col("__sel_sum") + F.col("__sel_rest") * F.col("__sel_value")) / F.nullif(F.col("__sel_below") + F.col("__sel_rest"), F.lit(0))).alias("loss"))


LOSSES = {"mse": lambda a, b: (a - b) * (a - b), "mae": lambda a, b: F.abs(a - b), "huber": lambda a, b: F.when(F.abs(a - b) <= 1, 0.5 * (a - b) * (a - b)).otherwise(F.abs(a - b) - 0.5)}


def batches(graphs: DataFrame, size: int, seed: int = 0, epoch: int = 0, id_col: str = "gid") -> DataFrame:
    """graphs with batch: groups of about size, dealt anew for each seed and epoch by a hash; no global order is made."""
    count = max(1, -(-graphs.count() // size))
    return graphs.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col)), F.lit(count)).cast("int"))


#: What a loader of each mode reads, and which of the three batch sizes counts for it.
MODES = {0: (("training", 0),), 1: (("training", 1), ("validation", 2)), 2: (("validation", 2),)}


def loader(graphs: dict[str, DataFrame], mode: int, sizes: tuple[int, int, int], seed: int = 0, epoch: int = 0, every: int = 10, shuffle: bool = True, id_col: str = "gid") -> dict[str, DataFrame]:
    """The tables of a mode (0: a first training, 1: training with validation, 2: validation) with batch; dealt anew every so many epochs if shuffle."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    return {role: batches(graphs[role], sizes[at], seed, epoch // every if shuffle and role == "training" else 0, id_col) for role, at in MODES[mode]}
