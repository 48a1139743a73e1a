"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where none is set, as in tests on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cairnfold-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A new path in that folder; what is there when the session's JVM ends is deleted with it."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(p)  # only what exists can be marked
    store.deleteOnExit(p)
    store.delete(p, True)
    return path


def settled(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: what several later steps read is computed once, and a lost executor costs nothing. A written table stays as it is."""
    if getattr(df, "_cairnfold_settled", False):
        return df
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairnfold_settled = True
    return out
