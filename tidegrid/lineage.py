"""Cutting the lineage of tables that a loop builds on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only a local session gets one of its own where none is set; on a cluster that is a RuntimeError."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return re.sub("^file:/(?!/)", "file:///", context.getCheckpointDir()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back, so that later steps neither recompute it nor carry its plan.

    For the folder see :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
