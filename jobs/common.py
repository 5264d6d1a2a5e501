"""What the jobs share: configuration, sessions of the command line, reading output back."""

from __future__ import annotations

import json
import logging
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def configured(kind: type[T], path: str | Path) -> T:
    """A configuration from a JSON file; names it doesn't know are an error."""
    given = json.loads(Path(path).read_text())
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def session(name: str) -> SparkSession:
    """The command line's own session; the master and other settings come from spark-submit."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def read_or_empty(spark: SparkSession, path: str, schema: str, modified: bool = False) -> DataFrame:
    """A Parquet table, or an empty one if nothing has been written there; `modified` adds the time when a row's file was written."""
    try:
        rows = spark.read.schema(schema).parquet(path)
        return rows.select("*", F.col("_metadata.file_modification_time").alias("modified")) if modified else rows
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, modified timestamp" if modified else schema)
