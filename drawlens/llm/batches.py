"""Corpus-wide counting of hashed keys with packed requests and replies.

Documents are staged once as batches (one row: a compressed Arrow table of some MB). Each batch asks for the keys it
holds, every key once per batch whatever its local count, so no key can make a hot spot larger than the number of
batches. Keys go to range buckets of the hash space as packed arrays (sorted, so that their upper bits shrink to
differences); each bucket sums the counts and answers every batch in the order of its request, so that answers are a few
bits or bytes a key. The batch is then read again from the staged table, which is why its composition never changes,
also when an executor is lost.

Buckets are as many as the corpus needs, and a batch's keys are spread over all of them: past a few thousand buckets a
request would hold a handful of keys. From FAN buckets on requests therefore travel in two steps. Batches ask ranges of
many buckets; in each range the requests of a set of batches merge into one, which is split over the range's buckets;
answers go back the same way. Rows then grow with the square root of what one step would need.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialise, tidy

STAGED = "batch bigint, role int, data binary"
REQUEST = "bucket bigint, batch bigint, role int, keys binary, extra binary"
REPLY = "batch bigint, bucket bigint, data binary"

#: Bytes of text in a batch, and keys that a bucket should hold: both bound a Python worker's memory.
BATCH_BYTES, BUCKET_KEYS = 4 << 20, 1 << 20
FAN = 4096  # buckets from which requests travel in two steps
MERGED = -1

Arrays = list[np.ndarray]


def pack(x: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, x.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(x.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack_arrays(arrays: Arrays) -> bytes:
    """Arrays one after another, each compressed behind its length; those of bytes objects as lengths and content."""
    squeeze, flat = zstandard.ZstdCompressor(level=1).compress, []
    for a in arrays:
        flat += [np.array([len(x) for x in a], "<u4").tobytes(), b"".join(a)] if a.dtype == object else [a.tobytes()]
    return b"".join(struct.pack("<I", len(x)) + x for x in map(squeeze, flat))


def unpack_arrays(data: bytes, kinds: list[str]) -> Arrays:
    expand, at = zstandard.ZstdDecompressor().decompress, 0

    def take() -> bytes:
        nonlocal at
        (n,) = struct.unpack_from("<I", data, at)
        at += 4 + n
        return expand(data[at - n : at])

    out = []
    for kind in kinds:
        if kind == "O":
            ends = np.cumsum(np.frombuffer(take(), "<u4"), dtype=np.int64).tolist()
            joined = take()
            out.append(np.array([joined[a:b] for a, b in zip([0, *ends], ends, strict=False)] + [b""], object)[:-1])
        else:
            out.append(np.frombuffer(take(), kind))
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: five low bytes as they are, differences of the rest compressed."""
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    high = np.diff((keys >> np.uint64(40)).astype(np.uint32), prepend=np.uint32(0))
    return struct.pack("<I", len(keys)) + low + zstandard.ZstdCompressor(level=1).compress(high.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 4).reshape(n, 5)
    high = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + 5 * n :]), np.uint32)
    return out.view("<u8").reshape(n) | (np.cumsum(high, dtype=np.uint64) << np.uint64(40))


def stage(docs: DataFrame, text: str, name: str, role: str | None = None, budget: int = BATCH_BYTES, prepare: Callable[[pa.Table], pa.Table] = lambda part: part) -> DataFrame:
    """Write docs as batches of one role each, as `prepare` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, budget):
            roles = sorted(set(part.column(role).to_pylist())) if role else [0]
            for r in roles:
                own = part.filter(pc.equal(part.column(role), r)) if role else part
                columns = [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([r], pa.int32()), pa.array([pack(prepare(own))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["batch", "role", "data"])

    return materialise(docs.mapInArrow(run, STAGED), name, "none")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range bucket of each 64-bit key; it does not fall as the key grows."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


@dataclass(frozen=True)
class Plan:
    """buckets of the hash space, and how many of them a batch's request covers at once."""

    buckets: int
    step: int

    def cut(self, keys: np.ndarray) -> np.ndarray:
        """Where each range of `step` buckets begins in sorted keys."""
        return np.searchsorted(bucket_of(keys, self.buckets) // np.uint64(self.step), np.arange(-(-self.buckets // self.step) + 1))


def plan(staged: DataFrame, keys_per_batch: int, least: int = 64, fan: int = FAN) -> Plan:
    """Range buckets so that each holds about BUCKET_KEYS keys (batches are counted from Parquet's footers)."""
    buckets = max(least, staged.count() * keys_per_batch // BUCKET_KEYS)
    return Plan(buckets, 1 if buckets < fan else 1 << (buckets.bit_length() // 2))


class Requests:
    """The requests that met in a bucket: keys one after another, where each request begins, extra arrays, batches, roles."""

    def __init__(self, frame: pd.DataFrame, kinds: list[str]):
        own = [unpack_keys(x) for x in frame["keys"]]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        self.keys = np.concatenate(own)
        del own
        parts = [unpack_arrays(x, kinds) for x in frame["extra"]]
        self.extra = [np.concatenate(x) for x in zip(*parts, strict=True)]
        self.batches, self.roles = frame["batch"].tolist(), frame["role"].tolist()

    def each(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the request, its part of x)."""
        for i in range(len(self.batches)):
            yield i, x[self.at[i] : self.at[i + 1]]


class Operation(Protocol):
    """What is asked and answered."""

    kinds: list[str]  # of the extra arrays; "O" for bytes objects

    def keys_of(self, part: pa.Table, role: int) -> list[tuple[int, np.ndarray, Arrays]]:
        """(kind, ascending keys, extra) of a batch; a kind has buckets of its own."""

    def reply(self, met: Requests, kind: int) -> Iterator[tuple[int, bytes]]:
        """(place of the request, or -1 for what is said besides, answer)."""

    def merge(self, met: Requests) -> tuple[np.ndarray, np.ndarray, Arrays]:
        """One request of several: inverse, ascending keys, extra. Its role is MERGED."""

    def pick(self, answers: list[tuple[bytes | None, int]], places: np.ndarray, role: int) -> bytes | None:
        """Of the answers (and numbers of entries) of consecutive buckets to a merged request, the entries at places.

        An operation whose merged entries lose something may have `settle(picked, met, i, places, extra)` besides: what
        request i of those met gets for what was picked, extra being the merged request's.
        """


def _rows(own: np.ndarray, keys: np.ndarray, extra: Arrays, kind: int, buckets: int) -> pd.DataFrame:
    """Keys and extra by (ascending) bucket or range `own`."""
    edges = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    spans = list(zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True)) if len(own) else []
    return pd.DataFrame({"bucket": own[edges].astype(np.int64) + kind * buckets, "keys": [pack_keys(keys[a:b]) for a, b in spans], "extra": [pack_arrays([x[a:b] for x in extra]) for a, b in spans]})


def count(staged: DataFrame, operation: Operation, how: Plan, name: str, known: DataFrame | None = None) -> DataFrame:
    """(batch, bucket, data): answers to the batches of staged, written under `name`; bucket is the first of a range's
    number, kind x buckets added. Rows of batch -1 are what the buckets said besides.

    known: answers to an earlier question; keys_of then gets those of its batch as a third argument, by bucket.
    """
    buckets, step, kinds = how.buckets, how.step, operation.kinds

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch, role, data in zip(frame.batch, frame.role, frame.data, strict=True):
                tidy()
                for kind, keys, extra in operation.keys_of(unpack(data), role):
                    yield _rows(bucket_of(keys, buckets).astype(np.int64) // step, keys, extra, kind, buckets).assign(batch=batch, role=role)

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tidy()
        met = Requests(frame, kinds)
        out = list(operation.reply(met, int(key[0]) // buckets))
        return pd.DataFrame({"batch": [met.batches[i] if i >= 0 else -1 for i, _ in out], "bucket": int(key[0]), "data": [x for _, x in out]})

    def ask_again(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tidy()
        got, out = dict(zip(right["bucket"].tolist(), right["data"], strict=True)), []
        for batch, role, data in zip(left["batch"], left["role"], left["data"], strict=True):
            for kind, keys, extra in operation.keys_of(unpack(data), role, got):
                out.append(_rows(bucket_of(keys, buckets).astype(np.int64) // step, keys, extra, kind, buckets).assign(batch=batch, role=role))
        return pd.concat(out)[["bucket", "batch", "role", "keys", "extra"]]

    first = staged.mapInPandas(ask, REQUEST) if known is None else staged.groupBy("batch").cogroup(known.groupBy("batch")).applyInPandas(ask_again, REQUEST)
    if step == 1:
        return materialise(first.groupBy("bucket").applyInPandas(answer, REPLY), name, "none")

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        tidy()
        _, keys, extra = operation.merge(Requests(frame, kinds))
        kind = int(frame["bucket"].iloc[0]) // buckets
        return _rows(bucket_of(keys, buckets).astype(np.int64), keys, extra, kind, buckets).assign(batch=int(frame["owner"].iloc[0]), role=MERGED)

    def returned(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tidy()
        if not len(left):
            return right.rename(columns={"owner": "batch"})[["batch", "bucket", "data"]]  # of batch -1
        met = Requests(left, kinds)
        inverse, keys, extra = operation.merge(met)
        kind = int(left["bucket"].iloc[0]) // buckets
        own, size = np.unique(bucket_of(keys, buckets).astype(np.int64) + kind * buckets, return_counts=True)
        data = dict(zip(right["bucket"].tolist(), right["data"], strict=True))
        answers = [(data.get(b), n) for b, n in zip(own.tolist(), size.tolist(), strict=True)]
        settle = getattr(operation, "settle", lambda picked, *_: picked)
        own = [(i, settle(operation.pick(answers, places, met.roles[i]), met, i, places, extra)) for i, places in met.each(inverse)]
        out = [(met.batches[i], x) for i, x in own if x is not None]
        return pd.DataFrame({"batch": [b for b, _ in out], "bucket": left["bucket"].iloc[0], "data": [x for _, x in out]})

    # A set of batches and a range of buckets make an owner, whose number stands for the batch in the second step.
    owner = F.pmod(F.xxhash64("batch"), F.lit(step)) + F.col("bucket") * step
    asked = materialise(first.withColumn("owner", owner), f"{name}-asked", "none")
    second = asked.groupBy("owner").applyInPandas(merged, REQUEST)
    answers = materialise(second.groupBy("bucket").applyInPandas(answer, REPLY), f"{name}-second", "none")
    out = materialise(asked.groupBy("owner").cogroup(answers.withColumnRenamed("batch", "owner").groupBy("owner")).applyInPandas(returned, REPLY), name, "none")
    discard(asked, answers)
    return out


def finish(staged: DataFrame, replies: DataFrame, use: Callable[[pa.Table, int, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Bring each batch and its replies together: `use` makes rows of schema from the batch, its role and its answers.

    All replies must be to batches of staged.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        got = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        return pa.concat_tables([use(unpack(data), role, got) for role, data in zip(left.column("role").to_pylist(), left.column("data").to_pylist(), strict=True)])

    return staged.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, schema)
