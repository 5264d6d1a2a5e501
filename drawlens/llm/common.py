"""Helpers shared by the training-data operators: reading, shared storage, chunking and hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() with no argument cuts at exactly these bytes.
WORD = rb"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # temporary folders of local contexts
_lock, _writers = threading.Lock(), {"n": 0, "before": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (local mode without the setting) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context not in _local:
        _local[context] = "file://" + tempfile.mkdtemp(prefix="drawlens-")
        atexit.register(shutil.rmtree, _local[context][7:], True)
    return _local[context]


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end inside are released at once (the setting is shared by threads that overlap)."""
    with _lock:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writers["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(CLEANUP, _writers["before"])


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind the write are released at its end, so that a job of several steps holds one step's
    shuffle at a time. `discard` deletes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._drawlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` returned; frames made from them must not be used afterwards."""
    for df in tables:
        remove(df.sparkSession, df._drawlens_path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(named(col).cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def tidy() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system (workers are used again)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, budget: int, rows: int = 1 << 20) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about `budget` bytes of `column` (one longer text stands alone)."""
    tidy()
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(lengths[at:]), max(budget - size, 1), side="right"))
            n = min(n, rows - count)
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(at, n))
                size, count, at = size + int(lengths[at : at + n].sum()), count + n, at + n
            if at < batch.num_rows or size >= budget or count >= rows:
                yield pa.Table.from_batches(held)
                held, size, count = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
    tidy()


_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # masks of the first k bytes
_LONGER = 256  # bytes of a word from which it is hashed by itself


class Words:
    """All words of some texts: hashes, one after another; `n`, how many each text has; and where they are in `buffer`.

    Words are mixed eight bytes at a time, all words at once, beginning from their length; so words of equal length up
    to eight bytes never meet.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join([b"", *texts, b"\n" * 9])
        self.buffer = buffer = joined.lower() if lower else joined
        gap = _GAP[np.frombuffer(buffer, np.uint8)]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.size = starts, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        h = mix(mix(size.astype(np.uint64)) ^ (eight[starts] & _FIRST[np.minimum(size, 8)]))
        live, k = np.flatnonzero((size > 8) & (size <= _LONGER)), 8
        while len(live):
            more = eight[starts[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]
            h[live] = mix(h[live] * np.uint64(0x9FB21C651E98DF25) ^ more)
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size > _LONGER).tolist():
            h[i] = xxhash.xxh64_intdigest(self.word(i))
        self.hashes = h
        self.n = np.diff(np.searchsorted(starts, np.cumsum([1, *(len(x) + 1 for x in texts)])))

    def word(self, i: int) -> bytes:
        at = int(self.starts[i])
        return self.buffer[at : at + int(self.size[i])]

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and for each word the number of its distinct one."""
        _, first, inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        return [self.word(i) for i in first.tolist()], inverse


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    words = Words(texts, lower)
    return words.hashes, words.n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def free_name(name: str, *taken: list[str]) -> str:
    """name, or name with underscores before it if a column has it (names are compared without case, as Spark does)."""
    held = {c.lower() for own in taken for c in own}
    while name.lower() in held:
        name = "_" + name
    return name


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def filter_rows(docs: DataFrame, text: str, start: Callable[[], Callable[[list[bytes]], np.ndarray]], budget: int = 4 << 20) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose texts are kept; start: made once a task, texts to flags."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    column = own.columns[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for part in chunks(batches, column, budget):
            yield from part.filter(pa.array(keep(text_bytes(part.column(column))), pa.bool_())).to_batches()

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
