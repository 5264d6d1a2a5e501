"""Approximate nearest neighbours by collision counting on single projections.

The rows are dealt into parts; each part is indexed by sorted arrays of its vectors' values on many Gaussian projections.
A query uses the arrays on which its own value is most extreme, for there neighbours and others lie furthest apart. In
each of these a window centred on the query's value is opened and widened, level by level, by a fixed ratio (virtual
rehashing of one level into the next): only the places that a level adds at either end are read, and every vector met
counts a collision. Vectors that exceed a threshold of collisions are verified with the original vectors in double
precision; widening stops when enough of the part have. Largest inner product becomes least distance by one more
component, sqrt(R^2 - |x|^2) with R the largest norm of the part.

Queries travel to every part in packed blocks; a block and a part meet in one task, so both sides are bounded whatever
the table's size (`PART` vectors, `QUERIES` queries). Every vector is indexed, none is sampled. Widening ends at the
latest when the windows hold the whole part, as they do where a part has no more vectors than are wanted.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part.
Equal vectors are ordered by id. Repeated ids are candidates of their own; a query's own id is never its candidate.
An empty table gives an empty result. Only the two columns named are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named

PROJECTIONS, USED, RATIO, SEED = 512, 64, 1.25, 20
PART, QUERIES, TOGETHER = 8192, 16384, 1024
FIRST = 0.25  # half the first window's width, in deviations of an array's values
THRESHOLD = 9  # collisions
SHARE, TIMES = 0.11, 25  # of a part that is verified before a query stops widening, and multiples of k at least


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v: array<double>) of the rows that take part."""
    v = named(vector).cast("array<double>")
    rows = vectors.select(named(vec_id).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


class Index:
    """Sorted arrays of one part."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.ids, self.vectors = ids, vectors
        norms = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        self.scale = np.sqrt(norms.max())
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]) / self.scale
        self.axes = np.random.default_rng(seed).standard_normal((lifted.shape[1], projections))
        values = (lifted @ self.axes).T.astype(np.float32)
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
        self.sorted = np.take_along_axis(values, self.order.astype(np.int64), 1)
        self.middle, self.spread = values.mean(1), np.maximum(values.std(1), 1e-9)

    def windows(self, at: np.ndarray, arrays: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Places between which each query's window lies in each of its arrays; at: its values there."""
        low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        width = FIRST * RATIO**level
        for m in np.unique(arrays).tolist():
            own = arrays == m
            low[own] = np.searchsorted(self.sorted[m], at[own] - width * self.spread[m])
            high[own] = np.searchsorted(self.sorted[m], at[own] + width * self.spread[m], "right")
        return low, high

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
        """The k best of the verified vectors for each query."""
        for a in range(0, len(ids), TOGETHER):
            yield self._search(ids[a : a + TOGETHER], queries[a : a + TOGETHER].astype(np.float64), k)

    def _search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        n, found = len(self.ids), []
        wanted = min(max(int(SHARE * n), TIMES * k), n)
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        values = (np.column_stack([queries / norms[:, None], np.zeros(len(queries))]) @ self.axes).astype(np.float32)
        used = min(USED, values.shape[1])
        extreme = np.abs((values - self.middle) / self.spread)
        arrays = np.sort(np.argpartition(-extreme, used - 1, axis=1)[:, :used], axis=1)
        at = np.take_along_axis(values, arrays, 1)
        least = min(THRESHOLD, used)
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        start = 0  # a query begins two levels below the one at which the last one stopped
        for q in range(len(ids)):
            count, level, place = np.zeros(n, np.uint16), start, None
            while True:
                while len(levels) <= level:
                    levels.append(self.windows(at, arrays, len(levels)))
                low, high = levels[level][0][q].tolist(), levels[level][1][q].tolist()
                own = arrays[q].tolist()
                if place is None:
                    added = [self.order[m, a:b] for m, a, b in zip(own, low, high, strict=True)]
                else:
                    added = [self.order[m, a:b] for m, a, b in zip(own, low, place[0], strict=True)] + [self.order[m, a:b] for m, a, b in zip(own, place[1], high, strict=True)]
                place = low, high
                count += np.bincount(np.concatenate(added), minlength=n).astype(np.uint16)
                got = np.flatnonzero(count >= least)
                if len(got) >= wanted:
                    break
                level += 1
            start = max(level - 1, 0)
            got = got[self.ids[got] != ids[q]]
            rough = self.vectors[got] @ queries[q]
            if len(got) > k:  # ties are settled by sums in one order
                edge = np.partition(rough, len(rough) - k)[len(rough) - k]
                got = got[rough >= edge - 1e-6 * max(1.0, self.scale * norms[q])]
            score = (self.vectors[got].astype(np.float64) * queries[q]).sum(1)
            best = np.lexsort((self.ids[got], -score))[:k]
            found.append((np.full(len(best), ids[q]), self.ids[got[best]], score[best]))
        query, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": query.astype(np.int64), "vec_id": vec.astype(np.int64), "score": score.astype(float)})


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest of all others."""
    rows = materialise(usable(vectors, vec_id, vector), "ann")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes["d"]
    rows = rows.where(F.size("v") == dim)
    parts = max(1, -(-sizes["count"] // PART))
    is_query = F.pmod("id", F.lit(every)) == 0
    blocks = max(1, -(-rows.where(is_query).count() // QUERIES))
    lanes = blocks  # each part is searched by as many tasks as there are blocks of queries
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))

    # Components that are floats travel as such: no value changes.
    number = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"

    def packed(frames):
        for frame in frames:
            if len(frame):
                for cell, own in frame.groupby("cell"):
                    yield pd.DataFrame({"cell": [cell], "ids": [own["id"].to_numpy(np.int64).tobytes()], "data": [np.concatenate(own["v"].to_numpy()).astype(number).tobytes()]})

    kind = "cell bigint, ids binary, data binary"
    data = rows.withColumn("cell", spread(parts, "part")).mapInPandas(packed, kind)
    data = data.select(F.explode(F.sequence(F.col("cell") * lanes, F.col("cell") * lanes + (lanes - 1))).alias("cell"), "ids", "data")
    asked = rows.where(is_query).withColumn("cell", spread(blocks, "block")).mapInPandas(packed, kind)
    asked = asked.select(F.explode(F.sequence(F.col("cell"), F.col("cell") + (parts - 1) * lanes, F.lit(lanes).cast("bigint"))).alias("cell"), "ids", "data")

    def joined(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(frame["ids"]), np.int64)
        order = np.argsort(ids, kind="stable")
        return ids[order], np.frombuffer(b"".join(frame["data"]), number).reshape(-1, dim)[order]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, own = joined(left)
        return pd.concat(list(Index(ids, own.astype(np.float64)).search(*joined(right), k)), ignore_index=True)

    found = data.groupBy("cell").cogroup(asked.groupBy("cell")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
