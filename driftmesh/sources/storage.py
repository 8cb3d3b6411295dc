"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/checkpoints/driftmesh"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session whose driver and executors are one process may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not _one_process(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table once and continue from its files: the lineage ends there, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/driftmesh/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
