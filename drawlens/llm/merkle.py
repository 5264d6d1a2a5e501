"""Merkle manifest of a table: a tree of digests a group, a tree over the groups' roots, and a proof for every row.

Rows of a group ascend by their key; while several nodes remain, every `arity` consecutive ones (the last run may be
shorter) become their parent, the SHA-256 of their hexadecimal digests one after another. The groups' roots, ordered by
group, become the root in the same way.

Nodes are keyed by tree, level and index, and the sizes of all trees are known before the first is hashed, so a run is
complete as soon as all of its nodes are there, whoever brings them. A set of nodes, of which every complete run has been
replaced by its parent, is a sparse forest; joining two forests and replacing again is associative and commutative.
Rows are range-partitioned and cut into blocks of consecutive rows. A block leaves O(arity * log n) nodes unresolved, two
neighbours together leave no more; a tree reduction over neighbouring blocks therefore handles small fragments in every
task until the root is left. Nodes that a block lacks for the proofs of its rows are all among the unresolved ones and
those made in the reduction: a join on their keys brings them, O(log n) a block. Nothing passes through the driver but
three counts.

Defined cases: null keys come first, so does the null group (which is one group, unlike the empty text); rows of equal
keys ascend by leaf; repeated rows are leaves of their own. Null fields of a leaf are `-`. A group may hold all rows, a
key may be repeated in any number of them (equal rows are dealt by their place in the input). An empty table gives an
empty result. Other columns are not read; those carried keep their names, the results come in one struct, whose name
gives way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .batches import pack, unpack
from .common import discard, free_name, materialise, named, tidy

BLOCK = 1 << 15  # rows of a block
FAN = 32  # fragments that a task of the reduction merges
TOP = -1  # the tree over the groups' roots
SLICE = 4096  # rows of proofs sent at once

NODE = "no bigint, tree bigint, level int, idx bigint, size bigint, digest binary, live boolean, made boolean"
Key = tuple[int, int, int]

_HEX = np.array([f"{i:02x}" for i in range(256)], "S2")


def field(value: Column) -> Column:
    """A field of a leaf: `-` if null, else its UTF-8 length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, in lower-case hexadecimal."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def parent(run: bytes) -> bytes:
    return sha256(run).hexdigest().encode()


def sizes(n: int, arity: int) -> list[int]:
    """Nodes at each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def inner(a: int, b: int, n: int, arity: int) -> tuple[int, int]:
    """The nodes from a to b (of n) whose runs lie wholly between them: from, to; equal if there are none."""
    lo = -(-a // arity) * arity
    hi = n if b == n else b // arity * arity
    return (lo, hi) if lo < hi else (b, b)


class Ranges:
    """What a range of leaves reaches at each level of its tree: `held` nodes known from them, `touched` ancestors."""

    def __init__(self, touched: tuple[int, int], held: tuple[int, int], n: int, arity: int):
        self.arity, self.sizes = arity, sizes(n, arity)
        self.held, self.touched = [held], [touched]
        for level in range(len(self.sizes) - 1):
            a, b = inner(*self.held[-1], self.sizes[level], arity)
            self.held.append((a // arity, -(-b // arity)) if a < b else (0, 0))
            a, b = self.touched[-1]
            self.touched.append((a // arity, (b - 1) // arity + 1))

    @property
    def depth(self) -> int:
        return len(self.sizes) - 1

    def run(self, level: int, node: int) -> range:
        first = node // self.arity * self.arity
        return range(first, min(first + self.arity, self.sizes[level]))

    def lacking(self) -> Iterator[tuple[int, int]]:
        """(level, index) of the nodes that proofs of the leaves need and that are not held, the root included."""
        for level in range(self.depth):
            a, b = self.held[level]
            ends = {self.touched[level][0], self.touched[level][1] - 1}
            for i in sorted({i for end in ends for i in self.run(level, end)}):
                if not a <= i < b:
                    yield level, i
        if self.held[-1] != (0, 1):
            yield self.depth, 0


def fold(digests: list[bytes], ranges: Ranges) -> list[list[bytes]]:
    """The held nodes of each level, from those of the first."""
    levels = [digests]
    for level in range(ranges.depth):
        (a, b), n = ranges.held[level], ranges.sizes[level]
        lo, hi = inner(a, b, n, ranges.arity)
        run, flat = 64 * ranges.arity, b"".join(levels[-1][lo - a : hi - a])
        levels.append([parent(flat[i : i + run]) for i in range(0, len(flat), run)])
    return levels


class Forest:
    """Unresolved nodes; `add` replaces complete runs by their parents. `groups`: how many trees there are."""

    def __init__(self, groups: int, arity: int):
        self.groups, self.arity = groups, arity
        self.live: dict[Key, bytes] = {}
        self.made: dict[Key, bytes] = {}
        self.size: dict[int, int] = {TOP: groups}

    def add(self, nodes: list[tuple[int, int, int, int, bytes]]) -> None:
        """nodes: (tree, level, index, leaves of the tree, digest)."""
        waiting: dict[tuple[bool, int, int], set[int]] = defaultdict(set)
        for tree, level, idx, n, digest in nodes:
            self.size[tree] = n
            self.live[tree, level, idx] = digest
            waiting[tree == TOP, level, tree].add(idx)
        while waiting:
            top, level, tree = at = min(waiting)
            own = sizes(self.size[tree], self.arity)
            for p in sorted({i // self.arity for i in waiting.pop(at)}):
                if level == len(own) - 1:
                    continue
                run = [(tree, level, i) for i in range(p * self.arity, min((p + 1) * self.arity, own[level]))]
                if all(key in self.live for key in run):
                    digest = parent(b"".join(self.live.pop(key) for key in run))
                    key = self.root_of(tree) if level + 1 == len(own) - 1 and tree != TOP else (tree, level + 1, p)
                    self.live[key] = self.made[key] = digest
                    waiting[key[0] == TOP, key[1], key[0]].add(key[2])

    @staticmethod
    def root_of(tree: int) -> Key:
        """A group's root is a leaf of the top tree."""
        return TOP, 0, tree


class Block:
    """Rows of a block by group, and which ranges of which trees they are."""

    def __init__(self, meta: dict, groups: int, arity: int, counts: list[int]):
        first, last = meta["tree"], meta["tree"] + len(counts) - 1
        self.parts: list[tuple[int, Ranges]] = []
        whole = []
        for k, n in enumerate(counts):
            start, size = 0, n
            if k == 0:
                start, size = meta["pos"] - meta["first_start"], meta["first_end"] - meta["first_start"]
            elif k == len(counts) - 1:
                size = meta["last_end"] - meta["last_start"]
            self.parts.append((first + k, Ranges((start, start + n), (start, start + n), size, arity)))
            if n == size:
                whole.append(first + k)
        held = (whole[0], whole[-1] + 1) if whole else (0, 0)
        self.top = Ranges((first, last + 1), held, groups, arity)

    def lacking(self) -> Iterator[Key]:
        for tree, ranges in {self.parts[0][0]: self.parts[0][1], self.parts[-1][0]: self.parts[-1][1]}.items():
            for level, i in ranges.lacking():
                yield Forest.root_of(tree) if level == ranges.depth else (tree, level, i)
        for level, i in self.top.lacking():
            yield TOP, level, i

    def unresolved(self, leaves: list[bytes]) -> Iterator[tuple[int, int, int, int, bytes]]:
        """Nodes without a known parent: (tree, level, index, leaves of the tree, digest)."""
        roots, at = [], 0
        for tree, ranges in self.parts:
            n = ranges.held[0][1] - ranges.held[0][0]
            levels = fold(leaves[at : at + n], ranges)
            at += n
            if ranges.held[-1] == (0, 1):
                roots += levels[-1]
            else:
                yield from self._open(tree, ranges, levels)
        yield from self._open(TOP, self.top, fold(roots, self.top))

    @staticmethod
    def _open(tree: int, ranges: Ranges, levels: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, bytes]]:
        for level, own in enumerate(levels):
            a, b = ranges.held[level]
            lo, hi = inner(a, b, ranges.sizes[level], ranges.arity) if level < ranges.depth else (b, b)
            for i in [*range(a, lo), *range(hi, b)]:
                yield tree, level, i, ranges.sizes[0], own[i - a]

    def proofs(self, leaves: list[bytes], found: dict[Key, bytes]) -> Iterator[tuple[int, Ranges, list, bytes, bytes]]:
        """For each group in the block: tree, ranges, for each level the run around each touched node as (before, after);
        the group's root; the root.
        """
        folded, roots, at = [], [], 0
        for _, ranges in self.parts:
            n = ranges.held[0][1] - ranges.held[0][0]
            folded.append(fold(leaves[at : at + n], ranges))
            at += n
            if ranges.held[-1] == (0, 1):
                roots += folded[-1][-1]
        top = fold(roots, self.top)

        def node(tree: int, ranges: Ranges, levels: list[list[bytes]], level: int, i: int) -> bytes:
            a, b = ranges.held[level]
            if a <= i < b:
                return levels[level][i - a]
            return found[Forest.root_of(tree) if level == ranges.depth and tree != TOP else (tree, level, i)]

        def around(tree: int, ranges: Ranges, levels: list[list[bytes]], level: int, i: int) -> tuple[bytes, bytes]:
            run = ranges.run(level, i)
            return tuple(b"".join(node(tree, ranges, levels, level, j) for j in part) for part in (range(run.start, i), range(i + 1, run.stop)))

        root = node(TOP, self.top, top, self.top.depth, 0)
        for (tree, ranges), levels in zip(self.parts, folded, strict=True):
            runs = [[around(tree, ranges, levels, level, i) for i in range(*ranges.touched[level])] for level in range(ranges.depth)]
            up, i = [], tree
            for level in range(self.top.depth):
                up.append([around(TOP, self.top, top, level, i)])
                i //= ranges.arity
            yield tree, ranges, runs + up, node(tree, ranges, levels, ranges.depth, 0), root


def hexed(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _counts(column: pa.ChunkedArray | pa.Array) -> list[int]:
    """Lengths of the runs of equal values (null is a value)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return np.diff(np.append(edges, len(codes))).tolist()


def _cut(ordered: DataFrame, block: int) -> DataFrame:
    """Blocks of consecutive rows: their partition and place in it, sizes, and the groups at both ends."""
    kind = ordered.schema["grp"].dataType.simpleString()
    schema = f"part int, seq int, n bigint, trees bigint, head {kind}, head_rows bigint, tail {kind}, tail_rows bigint, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            groups, counts = rows.column("grp").combine_chunks(), _counts(rows.column("grp"))
            values = [part, seq, len(rows), len(counts), groups[0].as_py(), counts[0], groups[-1].as_py(), counts[-1], pack(rows)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), groups.type, pa.int64(), groups.type, pa.int64(), pa.binary()]
            names = ["part", "seq", "n", "trees", "head", "head_rows", "tail", "tail_rows", "data"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        tidy()
        for batch in batches:
            while batch.num_rows:
                own = batch.slice(0, block - rows)
                held.append(own)
                rows, batch = rows + own.num_rows, batch.slice(own.num_rows)
                if rows == block:
                    yield made()
                    seq, held, rows = seq + 1, [], 0
        if held:
            yield made()

    return ordered.mapInArrow(run, schema)


def _placed(blocks: DataFrame) -> DataFrame:
    """Where each block begins: no, pos (rows before it), tree (number of its first group), and the ranges of all rows
    that the groups at its ends take. Running totals come in two steps, over partitions and within each.
    """
    inside = Window.partitionBy("part").orderBy("seq")
    meta = blocks.drop("data")
    ends = meta.groupBy("part").agg(F.max_by(F.struct("tail"), "seq").alias("end")).select("part", F.lag("end").over(Window.orderBy("part")).alias("earlier"))
    meta = meta.join(ends, "part").withColumn("before", F.coalesce(F.lag(F.struct("tail")).over(inside), "earlier"))
    goes_on = F.coalesce(F.col("before").isNotNull() & F.col("before.tail").eqNullSafe(F.col("head")), F.lit(False)).cast("bigint")
    meta = meta.select("part", "seq", "n", "trees", "head_rows", "tail_rows", goes_on.alias("same"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = meta.groupBy("part").agg(F.sum("n").alias("n0"), F.sum(F.col("trees") - F.col("same")).alias("t0"), F.count("*").alias("b0"))
    total = total.select("part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("n0", "t0", "b0")])
    here = inside.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda x: F.coalesce(F.sum(x).over(here), F.lit(0))
    return meta.join(total, "part").select(
        "part", "seq", "n", "trees", "head_rows", "tail_rows",
        (F.col("b0") + running(F.lit(1))).alias("no"), (F.col("n0") + running(F.col("n"))).alias("pos"),
        (F.col("t0") + running(F.col("trees") - F.col("same")) - F.col("same")).alias("tree"),
    )


def _with_ranges(placed: DataFrame) -> DataFrame:
    head = F.struct(F.col("tree").alias("t"), F.col("pos").alias("a"), (F.col("pos") + F.col("head_rows")).alias("b"))
    tail = F.struct((F.col("tree") + F.col("trees") - 1).alias("t"), (F.col("pos") + F.col("n") - F.col("tail_rows")).alias("a"), (F.col("pos") + F.col("n")).alias("b"))
    spans = placed.select(F.explode(F.array(head, tail)).alias("x")).groupBy("x.t").agg(F.min("x.a").alias("a"), F.max("x.b").alias("b"))
    first = spans.select(F.col("t").alias("tree"), F.col("a").alias("first_start"), F.col("b").alias("first_end"))
    last = spans.select(F.col("t").alias("last_tree"), F.col("a").alias("last_start"), F.col("b").alias("last_end"))
    own = placed.withColumn("last_tree", F.col("tree") + F.col("trees") - 1)
    return own.join(first, "tree").join(last, "last_tree").drop("last_tree", "head_rows", "tail_rows")


def _merged(groups: int, arity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(groups, arity)
        brought = set(zip(frame.tree, frame.level, frame.idx, strict=True))
        forest.add(list(zip(frame.tree, frame.level, frame.idx, frame["size"], frame.digest, strict=True)))
        rows = [(t, n, i, forest.size[t], x, (t, n, i) in forest.live, (t, n, i) not in brought) for (t, n, i), x in {**forest.live, **forest.made}.items()]
        out = pd.DataFrame(rows, columns=["tree", "level", "idx", "size", "digest", "live", "made"])
        return out.assign(no=int(frame["no"].iloc[0]) // FAN)[["no", "tree", "level", "idx", "size", "digest", "live", "made"]]

    return run


def prove(rows: DataFrame, key: str, group: str, leaf: str = "leaf", carry: tuple[str, ...] = (), arity: int = 2, block: int = BLOCK) -> DataFrame:
    """Per row: key, `carry` and a struct `merkle` (underscores before it if a column has that name) of leaf, position in
    its group, proof (for each level up to the root the run's digests before and after, one text each), subroot and root.

    leaf holds digests in hexadecimal. Fold a proof with `folded`.
    """
    spark, keep = rows.sparkSession, [key, *[c for c in carry if c != key]]
    place = [F.col(c).asc_nulls_first() for c in ("grp", "c0", "leaf")]
    staged = materialise(rows.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(group).alias("grp"), F.unhex(named(leaf)).alias("leaf")), "merkle-leaves")
    kinds = [staged.schema[f"c{i}"].dataType for i in range(len(keep))]
    proof = "proof array<struct<before:string,after:string>>"
    schema = ", ".join([*(f"c{i} {k.simpleString()}" for i, k in enumerate(kinds)), f"leaf string, position bigint, {proof}, subroot string, root string"])
    n = staged.count()
    if not n:
        return _named(spark.createDataFrame([], schema), keep)
    parts = max(-(-n // (8 * block)), min(spark.sparkContext.defaultParallelism, -(-n // 1024)))
    dealt = staged.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    ordered = dealt.repartitionByRange(parts, *place, F.col("salt")).sortWithinPartitions(*place).drop("salt")
    blocks = materialise(_cut(ordered, block), "merkle-blocks", "none")
    discard(staged)
    placed = materialise(_placed(blocks), "merkle-placed")
    where = materialise(_with_ranges(placed), "merkle-ranges")
    totals = placed.agg(F.max(F.col("tree") + F.col("trees")).alias("groups"), F.count("*").alias("blocks")).first()
    groups, count = totals["groups"], totals["blocks"]
    discard(placed)
    joined = blocks.select("part", "seq", "data").join(where, ["part", "seq"])
    metas = ["pos", "tree", "first_start", "first_end", "last_start", "last_end"]

    def fragments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                own = unpack(row["data"])
                nodes = list(Block(row, groups, arity, _counts(own.column("grp"))).unresolved(hexed(own.column("leaf"))))
                out = pd.DataFrame(nodes, columns=["tree", "level", "idx", "size", "digest"])
                yield out.assign(no=row["no"], live=True, made=True)[["no", "tree", "level", "idx", "size", "digest", "live", "made"]]

    rounds = [materialise(joined.select("no", *metas, "data").mapInPandas(fragments, NODE), "merkle-nodes")]
    while count > 1:
        live = rounds[-1].where("live")
        rounds.append(materialise(live.groupBy(F.floor(F.col("no") / FAN)).applyInPandas(_merged(groups, arity), NODE), "merkle-nodes"))
        count = -(-count // FAN)

    def needs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                # Groups between the first and the last lie wholly inside, whatever their sizes.
                trees = row["trees"]
                counts = [row["n"]] if trees == 1 else [row["first_end"] - row["pos"], *[1] * (trees - 2), row["pos"] + row["n"] - row["last_start"]]
                keys = sorted(set(Block(row, groups, arity, counts).lacking()))
                yield pd.DataFrame(keys, columns=["tree", "level", "idx"]).assign(no=row["no"])[["no", "tree", "level", "idx"]]

    nodes = rounds[0]
    for later in rounds[1:]:
        nodes = nodes.unionByName(later.where("made"))
    wanted = where.select("no", "n", "trees", *metas).mapInPandas(needs, "no bigint, tree bigint, level int, idx bigint")
    found = wanted.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    found = materialise(found.groupBy("no").agg(F.collect_list(F.struct("tree", "level", "idx", "digest")).alias("found")), "merkle-found")
    discard(*rounds)
    types = [to_arrow_type(k) for k in kinds]

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _proofs(row, unpack(row.pop("data")))

    def _proofs(row: dict, own: pa.Table) -> Iterator[pa.RecordBatch]:
        leaves = hexed(own.column("leaf"))
        known = {(x["tree"], x["level"], x["idx"]): x["digest"] for x in row["found"] or []}
        own, at = own.combine_chunks(), 0
        for _, ranges, levels, subroot, root in Block(row, groups, arity, _counts(own.column("grp"))).proofs(leaves, known):
            start, end = ranges.touched[0]
            sides = [[pa.array([pair[s] for pair in level]).cast(pa.string()) for level in levels] for s in (0, 1)]
            for a in range(start, end, SLICE):
                index = np.arange(a, min(a + SLICE, end))
                yield _records(own.slice(at + a - start, len(index)), index, ranges, sides, subroot, root, leaves[at + a - start :])
            at += end - start

    def _records(own: pa.Table, index: np.ndarray, ranges: Ranges, sides: list, subroot: bytes, root: bytes, leaves: list[bytes]) -> pa.RecordBatch:
        rows, depth, places = len(index), len(sides[0]), []
        for level in range(depth):
            places.append(index // ranges.arity**level - ranges.touched[level][0] if level < ranges.depth else np.zeros(rows, np.int64))
        offsets = pa.array(np.arange(rows + 1) * depth, pa.int32())
        if depth:
            starts = np.cumsum([0, *(len(x) for x in sides[0][:-1])])
            take = pa.array((np.stack(places, 1) + starts).ravel())
            texts = [pa.concat_arrays(side).take(take) for side in sides]
        else:
            texts = [pa.array([], pa.string())] * 2
        steps = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(texts, ["before", "after"]))
        columns = [own.column(f"c{i}").combine_chunks().cast(t) for i, t in enumerate(types)]
        columns += [pa.array(leaves[:rows]).cast(pa.string()), pa.array(index, pa.int64()), steps]
        columns += [pa.array([x.decode()] * rows, pa.string()) for x in (subroot, root)]
        return pa.RecordBatch.from_arrays(columns, [*(f"c{i}" for i in range(len(types))), "leaf", "position", "proof", "subroot", "root"])

    return _named(joined.select("no", *metas, "data").join(found, "no", "left").drop("no").mapInArrow(proofs, schema), keep)


def _named(out: DataFrame, keep: list[str]) -> DataFrame:
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.struct("leaf", "position", "proof", "subroot", "root").alias(free_name("merkle", keep)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda x, step: F.sha2(F.concat(step["before"], x, step["after"]), 256))


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def audit(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), counter: str = "n_chars", every: int = 7, block: int = BLOCK) -> DataFrame:
    """Proves every row against the root, some of them after tampering: where `every` divides the CRC-32 of the decimal id,
    the row presents itself with one more in `counter` (a null stays null). A null id is never tampered with.

    doc_id, leaf, subroot, root, proof_sha256 (as the table is), folded_root (from what the row presents), verified.
    """
    tampered = F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % every == 0, F.lit(False))
    changed = [named(c) + F.lit(1) if c == counter else named(c) for c in fields]
    rows = docs.select(named(doc_id).alias("id"), named(group).alias("grp"), leaf(*[named(c) for c in fields]).alias("leaf"), F.when(tampered, F.unhex(leaf(*changed))).alias("presented"))
    out = prove(rows, "id", "grp", "leaf", ("presented",), 2, block)
    m = F.col("merkle")
    shown = F.coalesce(F.lower(F.hex("presented")), m["leaf"])
    out = out.select(F.col("id").alias(doc_id), m["leaf"].alias("leaf"), m["subroot"].alias("subroot"), m["root"].alias("root"), siblings_digest(m["proof"]).alias("proof_sha256"), folded(shown, m["proof"]).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
