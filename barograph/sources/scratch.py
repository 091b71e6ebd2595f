"""Intermediate tables in the folder that the cluster shares: they cut long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = spark.conf.get("spark.barograph.localScratch", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="barograph-")
        spark.conf.set("spark.barograph.localScratch", path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
