"""The folder that a cluster shares, what is written there, and frames that are cut off from their history in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset on a machine alone, a folder in the warehouse; elsewhere it must be set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, remembered for clear()."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read again: later scans prune its columns and know its size."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, before clear() does; neither df nor what is made of it may be asked for again."""
    _written.remove(df.stored_at)
    _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this session has written under new_path(). Results that haven't been read out need it until then."""
    while _written:
        _delete(spark, _written.pop())


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, so that a lost executor costs no recomputation of what came before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
