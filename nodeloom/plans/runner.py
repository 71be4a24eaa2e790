"""A run from its settings: samples, a first training, training, predictions, and what they leave on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import readout, sampling
from ..operators.nn import train
from ..sources import tables
from .config import Run


def roles_of(packed: DataFrame, run: Run, values: DataFrame | None = None, **params) -> DataFrame:
    """(gid, role): test, pretrain, training and validation by the run's sampling, over values (gid, ..) where the method needs them; the split is that of test and of pretrain, and of four fifths of the rest for training."""
    rows = (packed.select("gid") if values is None else values).withColumnRenamed("gid", "id")
    found = sampling.three_way(rows, run.sampling.split, run.sampling.split, 0.8, run.sampling.seed, run.sampling.method, **params)
    return found.select(F.col("id").alias("gid"), "role")


def run_training(packed: DataFrame, run: Run, name: str = "0", roles: DataFrame | None = None, **params) -> tuple[dict, list[dict]]:
    """(weights, records): trains on packed graphs as run says and writes splits, models, epochs, predictions and, for interpretable models, rankings.

    With pretrain_epochs a first training on the rows of role pretrain comes
    before; its weights are where the other begins. Every epoch that is the
    best so far leaves its model.
    """
    spark, t, settings = packed.sparkSession, run.training, run.model.settings()
    roles = (roles_of(packed, run, **params) if roles is None else roles).withColumn("model_iter", F.lit(name))
    roles.write.mode("overwrite").parquet(f"{run.data_dir}/splits/{name}")
    splits = spark.read.parquet(f"{run.data_dir}/splits/{name}")
    of = lambda role: tables.read_split(packed, splits, role)
    spark.createDataFrame([(run.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{run.model_dir}/{name}/settings")
    weights = None
    common = {"optimizer": t.optimizer, "rate": t.learning_rate, "loss": t.loss, "most": t.max_deltas, "tolerance": t.tolerance, "most_loss": t.most_loss, "frozen": t.frozen, "reshuffle": t.shuffle_steps, "share": t.share}

    def saver(folder):
        return lambda w, record: tables.write_model(spark, w, f"{run.model_dir}/{name}/{folder}", name, record)

    for folder, role, epochs in (("pretraining", "pretrain", t.pretrain_epochs), ("training", "training", t.epochs)):
        if not epochs:
            continue
        rows = of(role)
        batches = max(1, -(-rows.count() // t.batch_size))
        valid = of("validation") if role == "training" else None
        weights, log = train.train(rows, valid, settings, epochs, batches, weights=weights, save=saver(folder), **common)
        tables.write_epochs(spark, log, f"{run.model_dir}/{name}", folder)
    weights = weights or train.initial_weights(settings)
    tables.write_predictions(train.predictions(of("test"), weights, settings), f"{run.data_dir}/results/{name}", "test")
    if run.model.interpretable:
        rows = train.contributions(of("test"), weights, settings)
        tables.write_rankings(readout.contribution_ratios(rows), f"{run.data_dir}/results/{name}")
    return weights, log if t.epochs or t.pretrain_epochs else []
