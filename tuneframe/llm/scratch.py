"""Intermediate tables in the shared folder the cluster names.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read, never a recomputation of an expensive
Python stage, and every executor sees the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master may go without one
    (tests): then a temporary folder is made and set; elsewhere it is an error."""
    root = spark.conf.get(CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="corpus-shared-")
    spark.conf.set(CONF, root)
    return root


class Scratch:
    """Tables of one operator call. Spark deletes the folder when the
    application ends; ``drop`` frees a table earlier."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        self._n = 0

    def save(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write ``df`` once and return the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path), True)
