"""Language-model scoring: n-grams mixed by deleted interpolation.

Maximum-likelihood estimates of every order, and an even chance for all words and one unknown, are mixed with weights
that depend on how often the context was seen (one set of weights for each order of the longest context seen and each
power of two of its frequency; orders whose context was never seen take no part, so every mixture sums to one). The
weights come from expectation-maximisation on a tenth of the training documents, whose own counts are left out
meanwhile; the final counts are those of all training documents. Counts are exact and cover all training text. They
stay distributed (see `batches`): a batch of documents gets the counts of its own n-grams only. For EM, held-out tokens
are summed by context bucket and by each component's probability to half an octave, a table whose size follows the
grid of these and not the corpus.

Null texts are empty (their only token is the end). A table without training rows scores every token 1 / (V + 1) with
V = 0; without EM rows the components that take part are mixed evenly. Repeated rows count as often as they occur. Texts
may be of any length (one longer than a batch stands alone). An empty table gives an empty result. Only the two columns
named are read, so others can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .common import crc_mod, mix, named, text_bytes, word_hashes

TRAIN, DELETED, TEST = 0, 1, 2
END, START = np.uint64(0x5BD1E995A7C3F10D), np.uint64(0xC2B2AE3D27D4EB4F)
ORDER, ROUNDS, OCTAVE = 3, 40, 2
NEVER = -(1 << 20)  # binned log of zero
LEVEL = 64  # buckets of one order of context


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words in lower case, then the end), and the number of tokens of each text."""
    words, n = word_hashes(texts, lower=True)
    n = n + 1
    out = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    here = np.ones(len(out), bool)
    here[ends] = False
    out[here] = words
    out[~here] = END
    return out, n


def ngrams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of the n-gram ending at each token, for each n; counts of tokens; which tokens begin a text."""
    first, n = tokens(texts)
    starts = np.cumsum(n) - n
    keys = [first]
    for level in range(2, order + 1):
        context = np.concatenate([[START], keys[-1][:-1]])
        context[starts] = START
        keys.append(mix(first + context * np.uint64(0x9FB21C651E98DF25) + np.uint64(level)))
    begins = np.zeros(len(first), bool)
    begins[starts] = True
    return keys, n, begins


class Counting:
    """Counts of the n-grams of one order over all training text, and over what of it is not deleted."""

    kinds = ["<u8", "<u8"]

    def __init__(self, text: str, order: int):
        self.text, self.order = text, order

    def keys_of(self, part: pa.Table, role: int) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        own, n = np.unique(ngrams(text_bytes(part.column(self.text)), self.order)[0][-1], return_counts=True)
        n = n.astype("<u8")
        return [(self.order - 1, own, [n * np.uint64(role != TEST), n * np.uint64(role == TRAIN)])]

    @staticmethod
    def summed(inverse: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(inverse, weights=x).astype("<u8")  # exact below 2^53

    def merge(self, met: batches.Requests) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        keys, inverse = np.unique(met.keys, return_inverse=True)
        return inverse, keys, [self.summed(inverse, x) for x in met.extra]

    def reply(self, met: batches.Requests, kind: int) -> Iterator[tuple[int, bytes]]:
        inverse, _, (whole, kept) = self.merge(met)
        if kind == 0:  # known words, tokens, tokens that are not deleted
            yield -1, np.array([(whole > 0).sum(), whole.sum(), kept.sum()], np.int64).tobytes()
        for i, own in met.each(inverse):
            yield i, batches.pack_arrays([whole[own], kept[own]][: self.arrays(met.roles[i])])

    @staticmethod
    def arrays(role: int) -> int:
        """Deleted batches also learn what counts are without them."""
        return 2 if role in (DELETED, batches.MERGED) else 1

    def pick(self, answers: list[tuple[bytes, int]], places: np.ndarray, role: int) -> bytes:
        parts = zip(*(batches.unpack_arrays(x, self.kinds) for x, _ in answers), strict=True)
        return batches.pack_arrays([np.concatenate(x)[places] for x in parts][: self.arrays(role)])


def looked_up(part: pa.Table, text: str, order: int, how: batches.Plan, got: dict[int, bytes], role: int, kept: bool) -> tuple:
    """Counts of the n-gram ending at each token and of its context, for each n (context of unigrams: none)."""
    keys, n, begins = ngrams(text_bytes(part.column(text)), order)
    counts = []
    for kind, level in enumerate(keys):
        own, inverse = np.unique(level, return_inverse=True)
        at = how.cut(own)
        values = np.zeros(len(own), np.uint64)
        for b in np.flatnonzero(np.diff(at)):
            values[at[b] : at[b + 1]] = batches.unpack_arrays(got[kind * how.buckets + b], ["<u8"] * Counting.arrays(role))[int(kept)]
        counts.append(values[inverse].astype(np.float64))
    ends = np.cumsum(n) - 1
    texts_seen = counts[0][ends[0]] if len(ends) else 0.0  # as often as the end
    contexts = [None]
    for level in counts[:-1]:
        context = np.concatenate([[0.0], level[:-1]])
        context[begins] = texts_seen
        contexts.append(context)
    return counts, contexts, n


def components(counts: list, contexts: list, total: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The context bucket of each token (LEVEL times the number of orders that take part, and the power of two of the
    longest context seen), and its probability in each order, the highest last.
    """
    n = len(counts[0])
    bucket = np.full(n, LEVEL * (total > 0), np.int64)
    out = [counts[0] / max(total, 1.0)]
    for level, (c, context) in enumerate(zip(counts[1:], contexts[1:], strict=True), 2):
        seen = context > 0
        bucket[seen] = LEVEL * level + np.log2(context[seen]).astype(np.int64)
        out.append(np.divide(c, context, out=np.zeros(n), where=seen))
    return bucket, out


def binned(p: np.ndarray) -> np.ndarray:
    """Logarithm of a probability to 1 / OCTAVE of an octave."""
    return np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1)) * OCTAVE), NEVER).astype(np.int64)


def em(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the columns of p (rows: how likely each makes a token, n times) by expectation-maximisation."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = p * w
        share /= share.sum(1, keepdims=True)
        w = n @ share / n.sum()
    return w


def fit(rows: pd.DataFrame, order: int, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of each context bucket: uniform first, then each order. Rows: bucket, q0.. (binned), n.

    A bucket without rows has the weights of all rows of its number of orders, evenly mixed ones if there are none.
    """
    out = np.zeros((LEVEL * (order + 1), order + 1))
    for level in range(order + 1):
        own = rows[rows["bucket"] // LEVEL == level]
        groups = [(slice(LEVEL * level, LEVEL * (level + 1)), own), *own.groupby("bucket")]
        for bucket, some in groups:
            if some.empty:
                w = np.full(level + 1, 1 / (level + 1))
            else:
                p = np.column_stack([np.full(len(some), uniform), *(np.where(some[f"q{i}"] == NEVER, 0.0, 2.0 ** (some[f"q{i}"] / OCTAVE)) for i in range(level))])
                w = em(p, some["n"].to_numpy(float), rounds)
                w[0] = max(w[0], 1e-6)  # an unknown word keeps a chance
            out[bucket, : level + 1] = w / w.sum()
    return out


def mixed(bucket: np.ndarray, p: list[np.ndarray], weights: np.ndarray, uniform: float) -> np.ndarray:
    """Probability of each token."""
    w = weights[bucket]
    return w[:, 0] * uniform + sum(w[:, i + 1] * x for i, x in enumerate(p))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, folds: int = 10, fan: int = batches.FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score (log10 of the mixture)."""
    held = F.when(crc_mod(doc_id, folds) == 0, TEST).when(F.floor(crc_mod(doc_id, folds * 10) / folds) == 0, DELETED).otherwise(TRAIN)
    staged = batches.stage(docs.select(named(doc_id).alias("doc"), named(text).alias("text"), held.cast("int").alias("role")), "text", "lm", "role")
    how = batches.plan(staged, batches.BATCH_BYTES // 8, fan=fan)
    counted = [batches.count(staged, Counting("text", n + 1), how, "lm-counts") for n in range(order)]  # one order's shuffle at a time
    replies = reduce(DataFrame.unionByName, counted)
    sums = counted[0].where("batch = -1").mapInPandas(_sums, "known bigint, total bigint, kept bigint").agg(F.sum("known"), F.sum("total"), F.sum("kept")).first()
    known, total, kept = (int(x or 0) for x in sums or (0, 0, 0))
    replies = replies.where("batch >= 0")
    grid = ["bucket", *(f"q{i}" for i in range(order))]

    def cells(part: pa.Table, role: int, got: dict[int, bytes]) -> pa.Table:
        bucket, p = components(*looked_up(part, "text", order, how, got, role, True)[:2], kept)
        rows, n = np.unique(np.column_stack([bucket, *map(binned, p)]), axis=0, return_counts=True)
        return pa.table({**{c: rows[:, i] for i, c in enumerate(grid)}, "n": n})

    own = replies.join(staged.where(f"role = {DELETED}").select("batch"), "batch", "left_semi")
    rows = batches.finish(staged.where(f"role = {DELETED}"), own, cells, ", ".join(f"{c} bigint" for c in [*grid, "n"]))
    uniform = 1.0 / (known + 1)
    weights = fit(rows.groupBy(*grid).agg(F.sum("n").alias("n")).toPandas(), order, uniform)

    def scored(part: pa.Table, role: int, got: dict[int, bytes]) -> pa.Table:
        counts, contexts, n = looked_up(part, "text", order, how, got, role, False)
        p = mixed(*components(counts, contexts, total), weights, uniform)
        base = np.log10((counts[0] + 0.1) / (total + 0.1 * (known + 1)))
        starts = np.cumsum(n) - n
        sums = lambda x: np.add.reduceat(x, starts) if len(x) else x
        columns = {"held_out": pa.array(np.full(len(n), role == TEST)), "n_tokens": n, "n_known": sums((counts[0] > 0).astype(np.int64)), "train_tokens": np.full(len(n), total), "base_score": sums(base), "score": sums(np.log10(p))}
        return pa.table({"doc": part.column("doc"), **columns})

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return batches.finish(staged, replies, scored, schema).withColumnRenamed("doc", doc_id)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        at = np.array([np.frombuffer(x, np.int64) for x in frame["data"]]).reshape(-1, 3)
        yield pd.DataFrame(at, columns=["known", "total", "kept"])


def fold(doc_id: object, n: int) -> int:
    """The Python twin of the fold rule, for tests."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
