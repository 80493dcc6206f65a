"""The folder that driver and executors share, and frames cut from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it names none, a local folder, but only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="graphweave-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def pin(df: DataFrame) -> DataFrame:
    """Computes and checkpoints ``df`` in the shared folder, and so finds out whether it can be computed at all."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
