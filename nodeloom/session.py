"""A Spark session with the settings that the operators are planned for."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, Arrow and UTC; further settings by name, dots written as double underscores."""
    builder = SparkSession.builder.appName("nodeloom")
    builder = builder.master(master) if master else builder
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per context, so that their Python workers find it wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_nodeloom_shipped", False):
        return
    root = pathlib.Path(__file__).parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="nodeloom-")) / "nodeloom.zip"  # on the driver; Spark copies it to the others
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"nodeloom/{path.relative_to(root)}")
    context.addPyFile(str(target))
    context._nodeloom_shipped = True
