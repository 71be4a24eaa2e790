"""Tables of graphs, splits, models, predictions and settings on disk; generated point clouds."""

from __future__ import annotations

import json
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut


def write_graph(graph: dict[str, DataFrame], path: str, buckets: int | None = None, database: str | None = None) -> None:
    """Each table of a graph as Parquet under path; with buckets and a database, as tables bucketed by gid, so that joins on it need no shuffle."""
    for name, df in graph.items():
        if buckets and database:
            df.write.mode("overwrite").bucketBy(buckets, "gid").sortBy("gid").option("path", f"{path}/{name}").saveAsTable(f"{database}.{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: tuple[str, ...] = ("nodes", "edges", "angles")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def bond_symbols(edges: DataFrame, nodes: DataFrame, symbol: str = "symbol") -> DataFrame:
    """edges with src_symbol and dst_symbol. Both meet by gid alone, the nodes of a graph as a map, so that over tables bucketed by gid no row moves, nor in what is grouped by gid after; a graph's nodes must fit a row."""
    of = nodes.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("node_id", symbol))).alias("__symbols"))
    found = edges.join(of.hint("merge"), "gid")
    return found.select(*edges.columns, *(F.element_at("__symbols", F.col(n)).alias(f"{n}_symbol") for n in ("src", "dst")))


def read_split(table: DataFrame, splits: DataFrame, role: str, model_iter: int | None = None) -> DataFrame:
    """The rows whose gid has a role; nothing is read before the result is."""
    chosen = splits.where(F.col("role") == role)
    if model_iter is not None:
        chosen = chosen.where(F.col("model_iter") == model_iter)
    return table.join(chosen.select("gid").distinct(), "gid", "left_semi")


def write_model(spark: SparkSession, weights: dict, path: str, model_id: str, info: dict | None = None, remove_old: bool = True) -> None:
    """Weights as rows (model_id, layer, name, shape, values), and what goes with them as JSON."""
    rows = [(model_id, name.rsplit(".", 1)[0], name, list(map(int, w.shape)), [float(v) for v in w.ravel()]) for name, w in weights.items()]
    mode = "overwrite" if remove_old else "append"
    spark.createDataFrame(rows, "model_id string, layer string, name string, shape array<int>, values array<double>").write.mode(mode).parquet(f"{path}/weights")
    record = {"model_id": model_id} | (info or {}) | {"system": system_info(spark).first().asDict()}
    spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/info")


def read_model(spark: SparkSession, path: str, model_id: str | None = None) -> dict:
    import numpy as np

    rows = spark.read.parquet(f"{path}/weights")
    rows = rows if model_id is None else rows.where(F.col("model_id") == model_id)
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows.collect()}


def read_model_info(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r[0]) for r in spark.read.text(f"{path}/info").collect()]


def write_dictionary(spark: SparkSession, values: dict, path: str) -> None:
    """A dictionary as JSON, a row per key; arrays become lists."""
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else str(v)
    rows = [(str(k), json.dumps(v, default=plain)) for k, v in values.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> dict:
    return {r["key"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()}


def write_predictions(predictions: DataFrame, path: str, name: str = "all") -> None:
    """(gid, pred, y, loss) under path, a folder per name; writing again replaces it."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions/name={name}")


def write_rankings(ratios: DataFrame, path: str) -> None:
    """Contributions and their ratios, a folder per dimension and kind."""
    ratios.write.mode("overwrite").partitionBy("dim", "kind").parquet(f"{path}/rankings")


EPOCH = "epoch int, loss_train double, loss_valid double, seconds double, saved boolean"


#: So many folders hold the epochs of all runs, each those whose ids have its number as their hash.
EPOCH_FOLDERS = 64


def write_epochs(spark: SparkSession, log: list[dict], path: str, run_id: str) -> None:
    """The records of a training as rows of EPOCH; writing again replaces it."""
    rows = [(x["epoch"], float(x["loss_train"]), float(x["loss_valid"]), float(x["seconds"]), bool(x["saved"]), run_id) for x in log]
    write_epoch_rows(spark.createDataFrame(rows, f"{EPOCH}, run_id string"), path)


def write_epoch_rows(epochs: DataFrame, path: str) -> None:
    """The same for rows of EPOCH of many runs (run_id, ..) at once; runs that are there already are replaced. Folders are as many for any number of runs."""
    spark = epochs.sparkSession
    typed = epochs.select(*(F.col(name).cast(kind) for name, kind in (x.split() for x in EPOCH.split(", "))), F.col("run_id").cast("string"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epochs")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        typed = cut(typed)
        fresh = typed.select(F.col("run_id").alias("__run")).distinct()
        touched = fresh.select(_epoch_folder("__run").alias("__folder")).distinct()
        kept = _epoch_rows(spark, path).join(F.broadcast(touched), F.col("folder") == F.col("__folder"), "left_semi")
        typed = typed.unionByName(kept.drop("folder").join(fresh, F.col("run_id").eqNullSafe(F.col("__run")), "left_anti"))
    dealt = typed.withColumn("folder", _epoch_folder("run_id")).repartition("folder")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{path}/epochs")


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return _epoch_rows(spark, path).drop("folder")


def _epoch_folder(run_id: str):
    return F.pmod(F.hash(run_id), F.lit(EPOCH_FOLDERS))


def _epoch_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{EPOCH}, run_id string, folder int").parquet(f"{path}/epochs")


def system_info(spark: SparkSession) -> DataFrame:
    context = spark.sparkContext
    row = (platform.node(), platform.system(), platform.machine(), platform.python_version(), spark.version, context.master, context.defaultParallelism)
    return spark.createDataFrame([row], "host string, system string, machine string, python string, spark string, master string, parallelism int")


def migrate(old: DataFrame, names: dict[str, str]) -> DataFrame:
    """A table of an older layout under new column names; what is written goes elsewhere, the old stays."""
    return old.withColumnsRenamed(names)


def random_clouds(spark: SparkSession, count: int = 1000, least: int = 10, most: int = 100, dims: int = 10, species: int = 4, k: tuple[int, int] = (3, 9), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(points, targets): clouds uniform in (-1, 1) with linearly growing size and number of neighbors, random species, and targets from 0 to 1."""
    i = F.col("gid")
    grow = lambda a, b: F.floor(F.lit(a) + i * F.lit((b - a) / max(count - 1, 1))).cast("int")
    graphs = spark.range(count).withColumnRenamed("id", "gid")
    points = graphs.withColumn("k", grow(*k)).withColumn("node_id", F.explode(F.sequence(F.lit(0).cast("long"), grow(least, most).cast("long") - 1)))
    number = lambda j: F.pmod(F.xxhash64(F.lit(seed), "gid", "node_id", j), F.lit(1 << 40)) / F.lit(float(1 << 40))
    points = points.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: number(j) * 2 - 1))
    points = points.withColumn("species_idx", F.pmod(F.xxhash64(F.lit(seed + 1), "gid", "node_id"), F.lit(species)).cast("int"))
    return points, graphs.select("gid", F.array(i / F.lit(float(max(count - 1, 1)))).alias("y"))
