"""Folders for queries that write: new ones under the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir (in local mode without that setting, under a temporary folder)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="drawlens-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
