"""Sessions: what a cluster's workers need to run the package's Python functions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        path = os.path.join(tempfile.mkdtemp(), "changelens.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(_ROOT):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("changelens", os.path.relpath(full, _ROOT)))
        spark.sparkContext.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of its own is made only on one machine, where the
    session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="changelens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/changelens/{name}-{uuid.uuid4().hex}"


def stepped(df: DataFrame, name: str, fresh: Column, before: DataFrame | None = None) -> tuple[DataFrame, int]:
    """One round of an iteration in one job: df as a table in the shared folder, and on how many of its rows
    `fresh` holds. The table of the round `before` is deleted."""
    spark, seen, path = df.sparkSession, Observation(), scratch(df.sparkSession, name)
    df.observe(seen, F.count_if(fresh).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._changelens_path = path
    if before is not None and (old := getattr(before, "_changelens_path", None)):
        at = spark._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out, int(seen.get["n"])


def cut(df):
    """df with its lineage cut by a checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
