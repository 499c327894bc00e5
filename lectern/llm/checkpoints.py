"""The folder for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir`` where the session names one; else, on one machine as in tests, a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
