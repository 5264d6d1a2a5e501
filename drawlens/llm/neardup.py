"""Near-duplicate documents: SimHash candidates and an exact prefix filter, verified by the Jaccard similarity of shingles.

Equal texts are one node. A node's fingerprint has the majority bits of its distinct five-word shingles; fingerprints
within `most` bits meet by the generalised pigeonhole principle of `simhash`, and in every cell each node proposes its
`nearest` closest neighbours, so that a group of near copies yields a number of pairs that is linear in its size. Proposals
are verified on the whole sets of shingles; pairs of similarity `similarity` or more are links, and documents reachable by
links a group.

A second pass finds every further pair, however far its fingerprints: in any order of all shingles two sets of that
similarity share one of the first n - ceil(similarity * n) + 1 of either. Those are its keys; pairs of different groups
that meet on one and whose sizes and parity bits allow the similarity are verified too, so that the groups are those of
all pairs. Shingles that are common in a sample come last in the order, which changes the cost but no result. Keys that
many nodes share are compared in cells of bounded size (see `pairing`). Before all such pairs are named, every node names a
few in each cell; what they link is one group by then, so that a large group of near copies names no more than a linear
number of pairs of its own.

Shingles are 64-bit hashes, so are the texts of nodes: n texts are expected to hold n^2 / 2^65 pairs taken for equal.
Null texts equal empty ones; texts of fewer words than a shingle compare as a whole; texts may be of any length. Rows with
a null id are kept apart (each its own group). Repeated rows are copies. An empty table gives an empty result. Columns of
any name are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairing, simhash
from .common import chunks, discard, free_name, materialise, mix, named, text_bytes, word_hashes
from .components import connected_components

MOST, NEAREST, SIMILARITY, SHINGLE = 6, 4, 0.8, 5
FAR = np.int64(2**62)
FEWEST, MARKS = 512, 8192  # parity bits of a shingle set, at least and at most
SAMPLE, COMMON, LONG = 4000, 2, 1 << 13  # texts that common shingles are found in, in how many of them, and their bytes
HEAD = 6  # members of a prefix that tell at which of its keys a pair is named
BROADCAST = 1 << 20  # nodes (8 bytes each) up to which those that are needed are broadcast
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's shingles, ascending; of fewer words the whole is the only one."""
    h, n = word_hashes(texts, lower=True)
    rolled = np.zeros(max(len(h) - shingle + 1, 0), np.uint64)
    for k in range(shingle):
        rolled = rolled * MULTIPLIER + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for k in n.tolist():
        if k >= shingle:
            out.append(np.unique(rolled[at : at + k - shingle + 1]))
        else:
            whole = np.array([k + 1], np.uint64)
            for x in h[at : at + k]:
                whole = mix(whole) + x
            out.append(whole)
        at += k
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of a set as 64-bit words: a power of two of them, of at least three quarters of its size within bounds."""
    bits = min(max(FEWEST, 1 << (3 * len(hashes) // 4).bit_length()), MARKS)
    counts = np.bincount((hashes >> np.uint64(13)).astype(np.int64) % bits, minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.uint64)


def possible(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, marks: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of places the sizes and parity bits allow to be similar: sets differ in at least as many members as
    their parity bits, those of the larger folded to as many as the smaller has.
    """
    small = np.minimum(sizes[i], sizes[j])
    good = small >= similarity * np.maximum(sizes[i], sizes[j])
    width = np.array([len(m) for m in marks], np.int64)
    at = np.flatnonzero(good)
    least = np.minimum(width[i[at]], width[j[at]])
    for w in np.unique(least).tolist():
        own = at[least == w]
        rows, back = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(marks[r].reshape(-1, w), axis=0) for r in rows.tolist()])
        for a in range(0, len(own), 1 << 14):
            some = own[a : a + (1 << 14)]
            x, y = back[a : a + len(some)], back[len(own) + a : len(own) + a + len(some)]
            apart = np.bitwise_count(folded[x] ^ folded[y]).sum(1, dtype=np.int64)
            both = sizes[i[some]] + sizes[j[some]]
            common = np.minimum((both - apart) // 2, small[some])
            good[some] = common >= similarity * (both - common)
    return good


def proposals(cell: np.ndarray, crossed: np.ndarray, part: np.ndarray, fps: np.ndarray, most: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of their cells: pairs of places of each one and its nearest within its cell (ties to the earlier)."""
    best = np.full((nearest, len(cell)), FAR, np.int64)

    def offer(to: np.ndarray, value: np.ndarray) -> None:
        for row in best:
            held = row[to]
            row[to], value = np.minimum(held, value), np.maximum(held, value)

    for i, j in pairing.at_lags(cell, crossed, part):
        d = np.bitwise_count(fps[i] ^ fps[j])
        close = d <= most
        if close.any():
            i, j, d = i[close], j[close], d[close].astype(np.int64) << 40
            offer(i, d | j)
            offer(j, d | i)
    slot, i = np.nonzero(best < FAR)
    return i, best[slot, i] & ((1 << 40) - 1)


def _pairs(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    pairs = np.unique(np.column_stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=0)
    return pd.DataFrame(pairs, columns=["u", "v"])


def candidates(nodes: DataFrame, most: int, nearest: int, chosen: list, limit: int) -> DataFrame:
    """Distinct pairs (u < v) of nodes (node, fp)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cell in pairing.whole_cells(frames):
            crossed = frame["a"].to_numpy() != frame["b"].to_numpy()
            i, j = proposals(cell, crossed, frame["part"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), most, nearest)
            yield _pairs(frame["node"].to_numpy(), i, j)

    return pairing.dealt(pairing.cells(simhash.by_key(nodes, chosen), limit=limit)).mapInPandas(run, "u bigint, v bigint").distinct()


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first members of a set (ascending) that a similar one must share one of; those of `common` come last."""
    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    return np.concatenate([hashes[~late], hashes[late]])[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]


def common_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of several of a sample's texts (rows: node, text): some SAMPLE distinct texts of LONG bytes at most."""
    share = max(1, rows.count() // SAMPLE)
    some = rows.where((F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(share)) == 0) & (F.octet_length("text") < LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            own = np.concatenate(shingle_sets(text_bytes(part.column("text")), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["key"])

    found = some.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "key bigint")
    keys = found.groupBy("key").count().where(F.col("count") >= COMMON).select("key").toArrow()
    return np.sort(keys.column("key").to_numpy().astype(np.int64).view(np.uint64))


def sketches(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, node, fp, size, marks, prefix) of rows (id, node, text)."""
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            sets = shingle_sets(text_bytes(part.column("text")), shingle)
            columns = [
                part.column("id").combine_chunks(), part.column("node").combine_chunks(), pa.array([simhash.fingerprint(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([parity(x).tobytes() for x in sets], pa.binary()), pa.array([prefix(x, common.value, similarity).tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "fp", "size", "marks", "prefix"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, node bigint, fp bigint, size bigint, marks binary, prefix binary")


def marks_of(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def first_of_each(i: np.ndarray, n: int) -> np.ndarray:
    """Which of the entries, equal ones together, are among the first n of their kind."""
    new = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    return np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < n


def prefix_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, group): a row for each member of a node's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "prefix", 4 << 20):
            keys = [np.frombuffer(x, np.int64) for x in part.column("prefix").to_pylist()]
            times = [len(k) for k in keys]
            columns = [np.concatenate(keys), *[np.repeat(part.column(c).to_numpy(), times) for c in ("node", "group")]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "group"])

    return nodes.select("node", "group", "prefix").mapInArrow(run, "key bigint, node bigint, group bigint")


def heads_of(column: pd.Series) -> np.ndarray:
    """The first HEAD members of each prefix, the last one repeated where it has fewer."""
    own = [np.frombuffer(x, np.int64) for x in column]
    return np.stack([np.pad(x, (0, HEAD - len(x)), mode="edge") for x in own]) if own else np.empty((0, HEAD), np.int64)


def own_key(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether this is the key that a pair is named at: the least that both heads (x, y) hold; any, if they share none."""
    both = np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int64).max).min(1)
    return (both == key) | (both == np.iinfo(np.int64).max)


def meetings(shared: DataFrame, nodes: DataFrame, similarity: float, few: int | None = None) -> DataFrame:
    """Pairs (u < v) of nodes of different groups that meet in a cell of `shared` (key, node, part, a, b) and may be similar.

    A pair meets at every key that its prefixes share, and is named at one: the least that is among the first HEAD of both
    prefixes. Pairs whose heads share none are named at each. With `few`, a node names so many in each cell instead.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cell in pairing.whole_cells(frames):
            # Within a block, in order of groups, each row meets those behind its group; across blocks, those of the second.
            crossed, part, group = (frame["a"] != frame["b"]).to_numpy(), frame["part"].to_numpy(), frame["group"].to_numpy()
            order = np.lexsort((np.where(crossed, part, group), cell))
            ids, key, group, size = (frame[c].to_numpy()[order] for c in ("node", "key", "group", "size"))
            marks = marks_of(frame["marks"].to_numpy()[order])
            heads = None if few else heads_of(frame["head"].to_numpy()[order])
            cell = cell[order]
            own = np.cumsum(np.append(0, (cell[1:] != cell[:-1]) | (np.where(crossed, part, group)[order][1:] != np.where(crossed, part, group)[order][:-1])))
            for i, j in pairing.spans(pairing.ends(own), pairing.ends(cell)):
                other = group[i] != group[j]
                i, j = i[other], j[other]
                good = possible(i, j, size, marks, similarity)
                i, j = i[good], j[good]
                if few and len(i):
                    first = first_of_each(i, few)
                    i, j = i[first], j[first]
                if heads is not None:
                    here = own_key(key[i], heads[i], heads[j])
                    i, j = i[here], j[here]
                if len(i):
                    yield _pairs(ids, i, j)

    head = [] if few else [F.substring("prefix", 1, 8 * HEAD).alias("head")]
    met = shared.drop("group").join(nodes.select("node", "group", "size", "marks", *head), "node")
    return pairing.dealt(met).mapInPandas(run, "u bigint, v bigint")


def more_candidates(nodes: DataFrame, similarity: float, limit: int, few: int | None = None) -> DataFrame:
    """Distinct pairs (u < v) of nodes (node, group, size, marks, prefix) of different groups that may be similar; with
    `few`, a node names about so many of those behind it in a cell.
    """
    shared = materialise(pairing.cells(prefix_keys(nodes), "group", limit), "neardup-keys")
    out = materialise(meetings(shared, nodes, similarity, few).distinct(), "neardup-more")
    discard(shared)
    return out


def allowed(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that sizes and parity bits allow to be similar."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = len(frame)
            sizes, marks = np.concatenate([frame["x"], frame["y"]]), [*marks_of(frame["p"]), *marks_of(frame["q"])]
            yield frame.loc[possible(np.arange(n), np.arange(n, 2 * n), sizes, marks, similarity), ["u", "v"]]

    own = nodes.select("node", "size", "marks")
    left = pairs.join(own.withColumnsRenamed({"node": "u", "size": "x", "marks": "p"}), "u")
    return left.join(own.withColumnsRenamed({"node": "v", "size": "y", "marks": "q"}), "v").mapInPandas(run, "u bigint, v bigint")


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of similar texts; rows: node, text."""
    needed = materialise(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "neardup-needed")
    few = F.broadcast(needed) if needed.count() <= BROADCAST else needed

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            own = [x.tobytes() for x in shingle_sets(text_bytes(part.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([part.column("node").combine_chunks(), pa.array(own, pa.binary())], ["node", "shingles"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for a, b in zip(frame["p"], frame["q"], strict=True):
                both = (len(a) + len(b)) // 8
                either = len(np.unique(np.frombuffer(a + b, np.uint64)))
                good.append(both - either >= similarity * either)
            yield frame.loc[np.array(good, bool), ["u", "v"]]

    texts = rows.join(few, "node", "left_semi").dropDuplicates(["node"])
    own = materialise(texts.mapInArrow(sets, "node bigint, shingles binary"), "neardup-sets")
    left = pairs.join(own.withColumnsRenamed({"node": "u", "shingles": "p"}), "u")
    out = materialise(left.join(own.withColumnsRenamed({"node": "v", "shingles": "q"}), "v").mapInPandas(run, "u bigint, v bigint"), "neardup-links")
    discard(needed, own)
    return out


def node_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(named(text), F.lit("")))


def _groups(docs: DataFrame, doc_id: str, text: str, similarity: float, shingle: int, most: int, nearest: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row with an id, and (node, id, component, group) of every distinct text; id is its smallest."""
    rows = docs.where(named(doc_id).isNotNull()).select(named(doc_id).alias("id"), node_of(text).alias("node"), F.coalesce(named(text), F.lit("")).alias("text"))
    marked = materialise(sketches(rows, shingle, similarity), "neardup-sketches")
    nodes = materialise(marked.groupBy("node").agg(F.min("id").alias("id"), F.first(F.struct("fp", "size", "marks", "prefix")).alias("s")).select("node", "id", "s.*"), "neardup-nodes")
    total = nodes.count()
    if total < 2:
        return marked.select("id", "node"), nodes.select("node", "id", F.col("id").alias("component"), F.col("node").alias("group"))
    ids = materialise(marked.select("id", "node"), "neardup-rows")
    discard(marked)
    texts = rows.select("node", "text")
    chosen = simhash.plan(simhash.sampled(nodes.select("node", "fp")), total, most)
    pairs = materialise(candidates(nodes.select("node", "fp"), most, nearest, chosen, limit), "neardup-pairs")
    near = materialise(allowed(pairs, nodes, similarity), "neardup-allowed")
    found = verified(near, texts, shingle, similarity)
    discard(pairs, near)
    links = materialise(connected_components(found), "neardup-first")
    for few in (nearest, None):  # large groups grow together before all pairs between groups are looked at
        known = nodes.join(links.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        more = more_candidates(known, similarity, limit, few)
        further = verified(more, texts, shingle, similarity)
        if not further.isEmpty():
            links = materialise(connected_components(links.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(further)), "neardup-further")
        discard(more, further)
    discard(found)
    labelled = nodes.select("node", "id").join(links.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = labelled.groupBy("group").agg(F.min("id").alias("component"))
    labels = materialise(labelled.join(least, "group").select("node", "id", "component", "group"), "neardup-labels")
    discard(nodes)
    return ids, labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, most: int = MOST, nearest: int = NEAREST, limit: int = pairing.LIMIT) -> DataFrame:
    """(id, node, component) per row with an id: component is the smallest id of the group, node the text's hash."""
    rows, labels = _groups(docs, doc_id, text, similarity, shingle, most, nearest, limit)
    return rows.join(labels.select("node", "component"), "node").select("id", "node", "component")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, most: int = MOST, nearest: int = NEAREST, limit: int = pairing.LIMIT) -> DataFrame:
    """The rows of docs, all columns, but one row of each group: that of the smallest id. Rows with a null id stay.

    Of several texts of that id in one group the one of the least hash stays; texts of different groups stay, each once.
    """
    rows, labels = _groups(docs, doc_id, text, similarity, shingle, most, nearest, limit)
    own, key, node = (free_name(x, docs.columns) for x in ("own_node", "kept_id", "kept_node"))
    chosen = labels.groupBy("group").agg(F.min(F.struct("id", "node")).alias("k"))
    chosen = materialise(chosen.select(F.col("k.id").alias(key), F.col("k.node").alias(node)), "neardup-kept")
    out = docs.where(named(doc_id).isNotNull()).withColumn(own, node_of(text)).join(chosen, (named(doc_id) == F.col(key)) & (F.col(own) == F.col(node)), "left_semi")
    repeated = rows.groupBy("id", "node").count().where("count > 1").limit(1).count()
    out = out.dropDuplicates([doc_id, own]) if repeated else out
    return out.drop(own).unionByName(docs.where(named(doc_id).isNull()))
