"""Cutting lineage by writing to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir. Where no folder is named, a temporary one serves if all of Spark runs on this
    machine, as in tests; on a cluster that is an error, as executors would each write to a disk of their own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tarnmill/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation. The folder
    goes with ``discard``, at the latest when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Removes the folders of frames that ``stored`` gave and that nothing reads any more; others are left alone."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            files, at = _folder(df.sparkSession, path)
            files.delete(at, True)
