"""Tables written on the way: lineage ends there, and what is used many times is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a temporary
    one on a local master; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tapeweave-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame, label: str = "table") -> DataFrame:
    """`df` as a Parquet table in the shared folder; it lives as long as that folder, like a checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/tapeweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
