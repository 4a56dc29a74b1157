"""Cutting lineage in shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Only a local session that has none gets a temporary one; elsewhere a missing ``spark.checkpoint.dir`` is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="burdenkit-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables of a job that goes in rounds, below the shared folder.

    A table replaces the one of its name, so rounds don't pile up on the disk. Unlike checkpoints, such tables
    tell Spark their size (a small one is broadcast) and small files are read together by few tasks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.tables = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again; the earlier table of the name goes."""
        path = f"{self.at}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.tables[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more, and let the driver notice shuffles that nothing refers to:
        Spark deletes their files when the references are collected."""
        for name in names:
            if path := self.tables.pop(name, None):
                remove(self.spark, path)
        gc.collect()  # frames in cycles hold on to the driver's references
        self.spark._jvm.System.gc()
