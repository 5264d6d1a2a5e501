"""Comparing the rows that share a key, however many they are.

The rows of a key are counted first (a partial aggregation); keys of one row, or whose rows are all of one group, leave.
A key of more than LIMIT rows is divided into blocks, and each pair of blocks is a cell that one task compares, so that
neither a task's rows nor its work grow with the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096


def cells(keyed: DataFrame, group: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Rows (key, node, ...) with their cell: columns a and b (numbers of its two blocks) and part (the row's own block)."""
    agg = [F.count("*").alias("n")] + ([F.min(group).alias("lo"), F.max(group).alias("hi")] if group else [])
    met = keyed.groupBy("key").agg(*agg).where("lo < hi" if group else "n > 1").select("key", F.ceil(F.col("n") / limit).cast("int").alias("blocks"))
    rows = keyed.join(met, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(others, lambda j: F.struct(F.least("part", j).alias("a"), F.greatest("part", j).alias("b")))
    return rows.withColumn("cell", F.explode(pairs)).select(*keyed.columns, "part", "cell.a", "cell.b")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of cells, each cell in one partition and in order."""
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "part", "node")


def whole_cells(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Regroup dealt frames so that no cell is divided; with each the number of its cell for every row."""
    held = None
    for frame in frames:
        if frame.empty:
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        own = numbers(frame)
        open_from = int(np.searchsorted(own, own[-1]))
        held, frame = frame.iloc[open_from:], frame.iloc[:open_from]
        if len(frame):
            yield frame, own[:open_from]
    if held is not None:
        yield held, np.zeros(len(held), np.int64)


def numbers(frame: pd.DataFrame) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    for c in ("key", "a", "b"):
        x = frame[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def ends(own: np.ndarray) -> np.ndarray:
    """For sorted labels, one past the end of each one's run."""
    if not len(own):
        return np.empty(0, np.int64)
    edge = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
    return np.repeat(edge[1:], np.diff(edge))


def at_lags(cell: np.ndarray, crossed: np.ndarray, part: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of one cell, those of two blocks only (crossed) if their parts differ; no place is twice in
    the first or in the second array of a yield.
    """
    last, at, lag = ends(cell), np.arange(len(cell)), 1
    while len(at := at[at + lag < last[at]]):
        for a in range(0, len(at), most):
            i = at[a : a + most]
            j = i + lag
            good = ~crossed[i] | (part[i] != part[j])
            if not good.all():
                i, j = i[good], j[good]
            if len(i):
                yield i, j
        lag += 1


def spans(start: np.ndarray, end: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) with start[i] <= j < end[i], some at a time."""
    n = np.maximum(end - start, 0)
    total = np.cumsum(n)
    for lo in range(0, int(total[-1]) if len(total) else 0, most):
        hi = min(lo + most, int(total[-1]))
        first, last = np.searchsorted(total, [lo, hi - 1], side="right")
        rows = np.arange(first, last + 1)
        before = total[rows] - n[rows]
        a, b = np.maximum(lo - before, 0), np.minimum(hi - before, n[rows])
        i = np.repeat(rows, b - a)
        run = np.cumsum(b - a)
        yield i, np.arange(len(i)) - np.repeat(run - (b - a), b - a) + np.repeat(start[rows] + a, b - a)
