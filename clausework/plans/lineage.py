"""Cutting lineage in iterative operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder for what outlives a task."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {spark.sparkContext.master} share")
    return (folder or "/tmp/clausework-checkpoints").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: A side is broadcast, or held by every task, only when its counted bytes stay under this.
SMALL_BYTES = 16 << 20


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to a new path in that folder and read back, so that plans which use it several times do its work once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names. Where none is set: in a folder of our own if the master is this machine, else an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
