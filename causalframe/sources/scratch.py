"""Folders and tables that need not last, where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession, name: str = "store") -> str:
    """A new folder below the one that the cluster shares, or on one machine, where none is
    set, a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("executors of a cluster share no local folder: set spark.checkpoint.dir")
    return f"{shared or tempfile.mkdtemp(prefix='causalframe-')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the checkpoint folder, without lineage: what is read
    more than once on the way to one result."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession, "checkpoints"))
    return df.checkpoint()
