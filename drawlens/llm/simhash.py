"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has a bit for each position that is set in over half of the XXH64 hashes of a text's word shingles. For
distance `most`, the 64 bits are grouped into partitions (correlated bits together, judged on a bounded sample), and a
dynamic programme gives each partition its own threshold t_i, so that sum(t_i + 1) = most + 1 at the least estimated
cost of keys and candidates: two fingerprints within `most` bits are within t_i in at least one partition. Candidates
meet on keys (t_i = 0: the partition's bits; t_i = 1 and 2: those with one or two bits left out; -1: partition unused)
and are verified on all 64 bits.

Equal fingerprints are joined beforehand, so a group of copies is one node however large; keys that many nodes share are
divided into cells of bounded size (see `pairing`), and within a cell only a spanning forest of verified links leaves the
task, never all pairs. Components come from `components`.

Null texts and texts without words have fingerprint zero and link like any other; texts may be of any length. Rows with a
null id get a fingerprint but take no part in links: their component is null. Repeated rows are copies. An empty table
gives an empty result. Only the two columns named are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairing
from .common import chunks, discard, materialise, named, text_bytes
from .components import connected_components

SAMPLE = 20_000  # fingerprints that the estimates are made from
SEED = 42
COST_KEY, COST_PAIR = 1.5e-6, 1.5e-8  # seconds for a key row and for a candidate, to weigh them


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of `width` words in lower case (A-Z), repeats included; of fewer words the whole."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), list(map(len, words))
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = (np.cumsum(size) + np.arange(len(size))).tolist()
    starts = [0, *[e + 1 for e in ends[: len(ends) - width]]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit number of the majority bits."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, fp) of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 8 << 20):
            fp = [fingerprint(shingle_hashes(x, width)) for x in text_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(named(doc_id).alias("id"), named(text).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def partitions(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size, each grown from its seed by the most correlated bits left."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    bits -= bits.mean(0)
    near = bits.T @ bits
    spread = np.sqrt(np.maximum(np.diag(near), 1e-9))
    near = np.abs(near / np.outer(spread, spread))
    left, out = set(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        own = [min(left)] if left else []
        left -= set(own)
        while len(own) < size:
            pick = max(sorted(left), key=lambda b: near[b, own].sum())
            own.append(pick)
            left.discard(pick)
        out.append(sorted(own))
    return out


def keys_of(bits: list[int], t: int) -> list[int]:
    """Masks under which two fingerprints within t bits in this partition agree at least once."""
    whole = sum(1 << b for b in bits)
    return [] if t < 0 else [whole & ~sum(1 << b for b in out) for out in combinations(bits, min(t, len(bits)))]


def allocate(sample: np.ndarray, total: int, most: int, parts: int) -> tuple[float, list[tuple[list[int], int]]]:
    """Estimated seconds and (bits, threshold) of each partition, by dynamic programming over the partitions."""
    groups = partitions(sample, parts)
    cost = []
    for bits in groups:
        row = {-1: 0.0}
        for t in range(min(most, 2) + 1):
            masks = keys_of(bits, t)
            tried = masks[:: max(1, len(masks) // 8)]
            same = []
            for mask in tried:
                n = np.unique(sample & np.uint64(mask), return_counts=True)[1].astype(float)
                same.append(max(((n * (n - 1)).sum() / max(len(sample) * (len(sample) - 1.0), 1.0)), 0.5 ** (len(bits) - t)))
            row[t] = len(masks) * (total * COST_KEY + total * total / 2 * float(np.mean(same)) * COST_PAIR)
        cost.append(row)
    best = {0: (0.0, [])}
    for bits, row in zip(groups, cost, strict=True):
        step: dict[int, tuple[float, list]] = {}
        for spent, (c, chosen) in best.items():
            for t, extra in row.items():
                to = spent + t + 1
                if to <= most + 1 and (to not in step or c + extra < step[to][0]):
                    step[to] = (c + extra, [*chosen, (bits, t)])
        best = step
    return best.get(most + 1, (float("inf"), []))


def plan(sample: np.ndarray, total: int, most: int) -> list[tuple[list[int], int]]:
    return min((allocate(sample, total, most, parts) for parts in range(2, most + 4)), key=lambda x: x[0])[1]


def forest(cell: np.ndarray, crossed: np.ndarray, part: np.ndarray, fps: np.ndarray, most: int) -> np.ndarray:
    """For rows in order of their cells: the least place that each is linked to, directly or not, within its cell."""
    parent = np.arange(len(cell))
    for i, j in pairing.at_lags(cell, crossed, part):
        close = np.bitwise_count(fps[i] ^ fps[j]) <= most
        x, y = parent[i[close]], parent[j[close]]
        while len(x):
            apart = x != y
            x, y = x[apart], y[apart]
            if not len(x):
                break
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            x, y = parent[x], parent[y]
    return parent


def by_key(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(key, node, fp) of nodes (node, fp), once for each key of the plan."""
    masks = [(i, mask) for i, (bits, t) in enumerate(chosen) for mask in keys_of(bits, t)]
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    keys = [F.xxhash64(F.lit(i), F.lit(str(m)), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in masks]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "fp")


def links(nodes: DataFrame, most: int, chosen: list[tuple[list[int], int]], limit: int = pairing.LIMIT) -> DataFrame:
    """Edges (u, v) between nodes (node, fp): in every key's cells a spanning forest of those within `most` bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cell in pairing.whole_cells(frames):
            ids = frame["node"].to_numpy()
            crossed = frame["a"].to_numpy() != frame["b"].to_numpy()
            parent = forest(cell, crossed, frame["part"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), most)
            child = np.flatnonzero(parent != np.arange(len(parent)))
            yield pd.DataFrame({"u": ids[child], "v": ids[parent[child]]})

    return pairing.dealt(pairing.cells(by_key(nodes, chosen), limit=limit)).mapInPandas(run, "u bigint, v bigint")


def sampled(nodes: DataFrame) -> np.ndarray:
    """A bounded sample of the fingerprints of nodes (node, fp)."""
    return nodes.orderBy(F.xxhash64("fp"), "node").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)


def near_groups(prints: DataFrame, most: int, limit: int = pairing.LIMIT) -> DataFrame:
    """(fp, component) for each distinct fingerprint of prints (id, fp)."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    known = nodes.where("node is not null")
    total = known.count()
    if total < 2:
        return nodes.select("fp", F.col("node").alias("component"))
    groups = connected_components(links(known, most, plan(sampled(known), total, most), limit))
    out = materialise(nodes.join(groups.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("fp", F.coalesce("component", "node").alias("component")), "simhash-groups")
    discard(nodes)
    return out


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, limit: int = pairing.LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable by links)."""
    prints = materialise(fingerprints(docs, doc_id, text, width), "simhash")
    groups = near_groups(prints, most, limit)
    out = prints.join(groups, "fp")
    return out.select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
