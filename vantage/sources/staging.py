"""Rows written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all its executors.

    Where it names none, a session in one process (tests) gets a folder of its own; on a cluster no folder of one machine
    would do, so that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where and context.master.split("[")[0] == "local":
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not where:
        raise ValueError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged_file(df: DataFrame) -> DataFrame:
    """The same rows from Parquet in the shared folder: unlike a checkpoint, readers take only the columns that they need."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
