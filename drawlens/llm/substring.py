"""Substring dedup: repeated windows of tokens, found by Rabin-Karp hashes counted over the whole corpus.

Every window of `width` consecutive words of every document is hashed (rolling polynomial over 64-bit word hashes) and
counted; windows counted twice or more mark their words, overlapping windows merge into maximal removal intervals.
Counting goes through `batches`: a window is sent once per batch, so a passage in a third of all documents loads its
bucket with one entry a batch.

Windows are equal if 64 bits of one polynomial and 32 of a second, over word hashes mixed anew, are. Powers of an odd
base modulo 2^64 differ by even numbers, so windows that differ by two words changing places may agree in the first at
2^-58; with the second, n windows are expected to hold less than n^2 / 2^91 false pairs (0.1 in 10^13 windows, some 60 TB
of text).

Null texts are empty; documents with fewer words than `width` have no window and stay whole; texts may be of any length
(one longer than a batch stands alone). Repeated rows are copies like any other. An empty table gives an empty result.
Columns that are carried keep their names whatever these are: the results come in one struct, whose name gives way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .common import free_name, mix, named, text_bytes, word_hashes

WIDTH = 35
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd: powers have inverses modulo 2^64


def rolling(h: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hash of h[i:i+width] for every i, modulo 2^64."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.full(n, base, np.uint64))
    back = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])
    return mix((total[width:] - total[:-width]) * back[: n - width + 1])


def windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, both hashes of every window, and its start among all words."""
    h, n = word_hashes(texts)
    left = np.repeat(np.cumsum(n), n)[: max(len(h) - width + 1, 0)]  # words from here to the text's end
    start = np.flatnonzero(left - np.arange(len(left)) >= width)
    check = (rolling(mix(h + np.uint64(SECOND)), width, SECOND)[start] >> np.uint64(32)).astype("<u4")
    return n, rolling(h, width)[start], check, start


def distinct(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the number of its kind, in ascending order; and where the first of each kind is."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], check[order]
    new, other = k[1:] != k[:-1], c[1:] != c[:-1]
    if (other & ~new).any():  # one key, several checks
        order = np.lexsort((check, keys))
        k, c = keys[order], check[order]
        new, other = k[1:] != k[:-1], c[1:] != c[:-1]
    new = np.append(True, new | other)[: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return inverse, order[new]


class Repeats:
    """Which windows occur twice or more in the corpus: a bit for each, no answer where none does."""

    kinds = ["<u4", "|u1"]

    def __init__(self, text: str, width: int):
        self.text, self.width = text, width

    def keys_of(self, part: pa.Table, role: int) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        _, keys, check, _ = windows(text_bytes(part.column(self.text)), self.width)
        inverse, first = distinct(keys, check)
        return [(0, keys[first], [check[first], (np.bincount(inverse, minlength=len(first)) > 1).astype(np.uint8)])]

    def merge(self, met: batches.Requests) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        check, twice = met.extra
        inverse, first = distinct(met.keys, check)
        return inverse, met.keys[first], [check[first], (np.bincount(inverse) + np.bincount(inverse, weights=twice) > 1).astype(np.uint8)]

    def reply(self, met: batches.Requests, kind: int) -> Iterator[tuple[int, bytes]]:
        inverse, _, (_, twice) = self.merge(met)
        for i, own in met.each(inverse):
            if (bits := twice[own]).any():
                yield i, np.packbits(bits).tobytes()

    def pick(self, answers: list[tuple[bytes | None, int]], places: np.ndarray, role: int) -> bytes | None:
        bits = np.concatenate([np.zeros(n, np.uint8) if x is None else np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in answers])[places]
        return np.packbits(bits).tobytes() if bits.any() else None


def repeated_windows(staged: DataFrame, text: str, width: int, fan: int) -> tuple[DataFrame, batches.Plan]:
    """Answers that tell each batch which of its windows occur twice or more in the corpus."""
    how = batches.plan(staged, batches.BATCH_BYTES // 7, fan=fan)
    return batches.count(staged, Repeats(text, width), how, "substring-repeats"), how


def covered(texts: list[bytes], width: int, how: batches.Plan, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and whether each word is covered by a repeated window."""
    n, keys, check, start = windows(texts, width)
    inverse, first = distinct(keys, check)
    twice = np.zeros(len(first), bool)
    at = how.cut(keys[first])
    for bucket, bits in got.items():
        a, b = at[bucket], at[bucket + 1]
        twice[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    edge = np.zeros(int(n.sum()) + 1, np.int64)
    hit = start[twice[inverse]] if len(first) else start
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return n, np.cumsum(edge[:-1]) > 0


def left_of(text: bytes, gone: np.ndarray) -> bytes:
    """The words that are not gone, joined by one space."""
    words = text.split()
    return b" ".join([words[k] for k in np.flatnonzero(~gone)] if gone.any() else words)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, carry: tuple[str, ...] = (), fan: int = batches.FAN) -> DataFrame:
    """Per row of docs: doc_id, `carry` and, last, a struct `repeats` (underscores before it if a column has that name) of
    n_words, n_removed, removed (maximal intervals as word positions, end exclusive) and kept_text (the whole text if
    nothing is removed, else the kept words joined by one space).
    """
    keep = [doc_id, *[c for c in carry if c != doc_id]]
    staged = batches.stage(docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(text).alias("text")), "text", "substring")
    replies, how = repeated_windows(staged, "text", width, fan)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def use(part: pa.Table, role: int, got: dict[int, bytes]) -> pa.Table:
        whole = part.column("text").to_pylist()
        data = text_bytes(part.column("text"))
        n, gone = covered(data, width, how, got)
        spans, texts, removed = [], [], []
        for i, end in enumerate(np.cumsum(n).tolist()):
            g = gone[end - int(n[i]) : end]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            removed.append(int(g.sum()))
            texts.append(left_of(data[i], g).decode() if removed[-1] else whole[i])
        out = part.drop_columns(["text"])
        for name, column in (("n_words", pa.array(n)), ("n_removed", pa.array(removed, pa.int64())), ("removed", pa.array(spans, span)), ("kept_text", pa.array(texts, pa.string()))):
            out = out.append_column(name, column)
        return out

    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string"])
    out = batches.finish(staged, replies, use, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.struct("n_words", "n_removed", "removed", "kept_text").alias(free_name("repeats", keep)))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows and columns of docs; the text is what is left of it."""
    out = remove_repeats(docs, doc_id, text, width, tuple(c for c in docs.columns if c != text))
    return out.select(*[named(out.columns[-1])["kept_text"].alias(c) if c == text else named(c) for c in docs.columns])


def kept_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, fan: int = batches.FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    staged = batches.stage(docs.select(named(doc_id).alias("doc"), named(text).alias("text")), "text", "substring")
    replies, how = repeated_windows(staged, "text", width, fan)

    def use(part: pa.Table, role: int, got: dict[int, bytes]) -> pa.Table:
        data = text_bytes(part.column("text"))
        n, gone = covered(data, width, how, got)
        digest, removed, at = [], [], 0
        for text_, k in zip(data, n.tolist(), strict=True):
            g = gone[at : at + k]
            at += k
            removed.append(int(g.sum()))
            digest.append(hashlib.sha256(left_of(text_, g)).hexdigest())
        return pa.table({"doc": part.column("doc"), "n_words": n, "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    kind = docs.schema[doc_id].dataType.simpleString()
    return batches.finish(staged, replies, use, f"doc {kind}, n_words bigint, n_removed bigint, kept_sha256 string").withColumnRenamed("doc", doc_id)
