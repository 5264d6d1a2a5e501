"""Thresholds that follow the outcomes of their constraints: keyed state in a stream.

An outcome is (name, place, success, error). A failure pushes its threshold up, the more the greater the error is, a success
pulls it down a little; pushes add up with momentum, and a threshold stays within a span of its first value. The state of
a name is a few numbers and its newest outcomes, whatever came before. Outcomes of a load follow those of the loads before;
within a load they are ordered by place, ties by success and error. Those of unknown names or without success are left out.
The outcomes of one name in one load meet in one task, as each depends on the one before; files_per_load bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "name int, place bigint, success boolean, error double"
STATE = "threshold double, velocity double, attempts bigint, failures bigint, newest array<boolean>"
RESULT = "name int, threshold double, velocity double, attempts bigint, failures bigint, success_rate double, relax boolean"


@dataclass(frozen=True)
class Pace:
    """rate, momentum: of the pushes; span: of a threshold around its first value; kept: outcomes that the success rate
    looks back on; a constraint should be relaxed if less than `least` of them succeeded, after `trial` outcomes.
    """

    rate: float = 0.01
    momentum: float = 0.9
    span: float = 10.0
    kept: int = 100
    trial: int = 50
    least: float = 0.1


def follow(outcomes: DataFrame, initial: dict[int, float], pace: Pace = Pace()) -> DataFrame:
    """Streaming outcomes to a row of RESULT for each name and load; initial has the first threshold of every name."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = initial[key[0]]
        x, v, attempts, failures, newest = state.get if state.exists else (first, 0.0, 0, 0, [])
        rows = pd.concat([p[["place", "success", "error"]] for p in parts]).sort_values(["place", "success", "error"])
        won = rows["success"].to_numpy(bool)
        error = rows["error"].to_numpy(float)
        error = np.where(np.isnan(error) | (error == 0), 0.2, np.minimum(error, 0.5))  # unknown errors count as 0.2
        for push in (pace.rate * np.where(won, -0.1, error)).tolist():
            v = pace.momentum * v + push
            x = min(max(x + v, first / pace.span), first * pace.span)
        attempts, failures = attempts + len(won), failures + int((~won).sum())
        newest = [*newest, *won[-pace.kept :].tolist()][-pace.kept :]
        state.update((x, v, attempts, failures, newest))
        share = sum(newest) / len(newest)
        yield pd.DataFrame([(key[0], x, v, attempts, failures, share, attempts >= pace.trial and share < pace.least)], columns=[c.split()[0] for c in RESULT.split(", ")])

    known = outcomes.where(F.col("name").isin(*initial) & F.col("success").isNotNull()).select("name", "place", "success", "error")
    return known.groupBy("name").applyInPandasWithState(run, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def take(spark: SparkSession, path: str, output: str, checkpoint: str, initial: dict[int, float], pace: Pace = Pace(), files_per_load: int = 1000) -> None:
    """Follows all outcomes in Parquet files that are new below path, and stops. A load that is done again replaces its rows."""

    def load(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("load", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(output)

    outcomes = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", files_per_load).parquet(path)
    follow(outcomes, initial, pace).writeStream.outputMode("update").foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, output: str) -> DataFrame:
    """The newest row of every name."""
    rows = spark.read.schema(RESULT + ", load bigint").parquet(output)
    return rows.withColumn("newest", F.max("load").over(Window.partitionBy("name"))).where(F.col("load") == F.col("newest")).drop("newest", "load")
