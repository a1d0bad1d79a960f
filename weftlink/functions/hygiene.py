"""Small helpers that every operator shares: internal names, tables, lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in spark.checkpoint.dir. Where that is unset a local master gets
    a folder of its own, deleted when Python ends; on any other master this raises, as no executor could read it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    own = tempfile.mkdtemp(prefix="weftlink-checkpoints-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared folder, so a lost executor costs a read and no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(os.path.join(shared_dir(df.sparkSession), f"weftlink-{uuid.uuid4().hex}"))
    return df.checkpoint(eager=True)


def drop_checkpoints(spark: SparkSession) -> None:
    """Deletes what ``cut`` wrote in this application. Tables that still read it are lost."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session, wherever they start; once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")  # served to executors by the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
