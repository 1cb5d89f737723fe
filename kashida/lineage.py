"""Results that are computed once and stored where every executor finds them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, or one that was set before. Where neither is, a temporary folder
    is set if all runs on one machine, as in tests; on a cluster, whose machines could not read it, that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kashida-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder, so that a lost executor costs nothing."""
    folder(df.sparkSession)
    return df.checkpoint()


def shared(spark: SparkSession, name: str) -> str:
    """A folder for written tables beside the checkpoints."""
    return os.path.join(folder(spark), name)
