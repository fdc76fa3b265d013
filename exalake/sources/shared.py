"""Cutting lineage between the rounds of an iterative job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared folder (spark.checkpoint.dir) and read from there; lost executors don't matter to it.

    Where that is unset, a folder on this machine is taken if everything runs in this one process, and nothing else works.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or f"file://{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()
