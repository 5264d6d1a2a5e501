"""The graph of numbers drawn together: edges, weighted random walks, embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import cooccurrence


def edges(h: DataFrame, decay: float = 0.97) -> DataFrame:
    """(src, dst, weight) in both directions."""
    one = cooccurrence(h, decay)
    return one.select(F.col("i").alias("src"), F.col("j").alias("dst"), "weight").unionByName(one.select(F.col("j").alias("src"), F.col("i").alias("dst"), "weight"))


def random_walks(h: DataFrame, walks: int = 5, length: int = 10, decay: float = 0.97, seed: int = 42) -> DataFrame:
    """(walk, start, nodes): steps by weight, evenly from a node without edges; the 80 x 80 matrix goes with the task."""
    m = np.zeros((80, 80))
    for r in edges(h, decay).collect():
        m[r["src"] - 1, r["dst"] - 1] = r["weight"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in frame["id"]:
                r, at = np.random.default_rng([seed, i]), int(i) % 80
                nodes = [at + 1]
                for _ in range(length - 1):
                    w = m[at] if m[at].sum() > 0 else np.ones(80)
                    at = int(r.choice(80, p=w / w.sum()))
                    nodes.append(at + 1)
                out.append((int(i) // 80, nodes[0], nodes))
            yield pd.DataFrame(out, columns=["walk", "start", "nodes"])

    return h.sparkSession.range(80 * walks).mapInPandas(run, "walk bigint, start int, nodes array<int>")


def embeddings(walks: DataFrame, dim: int = 16, seed: int = 42) -> DataFrame:
    """(num, vec) by skip-grams over the walks."""
    from pyspark.ml.feature import Word2Vec

    words = walks.select(F.col("nodes").cast("array<string>").alias("words"))
    model = Word2Vec(vectorSize=dim, minCount=0, seed=seed, inputCol="words", outputCol="v", maxIter=2).fit(words)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").cast("int").alias("num"), vector_to_array("vector").alias("vec"))
