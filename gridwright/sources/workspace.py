"""Where a session keeps checkpoints and written tables: the folder that the cluster names, a temporary one only in local mode."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def use_checkpoints(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="gridwright-")
        spark.conf.set("spark.checkpoint.dir", named)
    spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{use_checkpoints(spark).rstrip('/')}/gridwright-{label}-{uuid.uuid4().hex}"
