"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

Texts are cut into pieces by the pattern and staged as numbers of their batch's distinct pieces. The pieces that are no
token themselves go, as `batches` deals keys, to the bucket of their hash, so that every distinct piece of the corpus is
encoded once. A bucket's pieces are laid out as one array of byte tokens with links to neighbours. An inverted index from
the rank of a pair to the positions that hold it yields the merges in rank order; a merge touches only its neighbours,
whose new pairs enter the index. Equal pairs of one piece merge at once, every other one from the left where they
overlap, unless a merge would make a pair of a lower rank, which then goes first; so results equal the library's and a
piece of n equal characters takes time in proportion to n. The batches get the ids of their pieces and put the texts
together.

Null texts are empty and have no ids. Repeated rows are encoded like any other; texts may be of any length (one longer
than a batch stands alone, a piece may be as long as its text). An empty table gives an empty result. Only the two columns
named are read, so others can't clash. A rank file's path is a parameter; its tokens are sent with the tasks' closure
(under 1 MB for 50,000 entries, a property of the vocabulary and not of the data).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .common import chunks, named, released_shuffles, remove, shared_dir

NONE = np.int32(2**31 - 1)
SHIFT = np.int64(20)
#: Bytes of text in a batch, and distinct pieces that are no tokens in one, to size the buckets. A batch asks for each of
#: its distinct pieces once, and texts share most of them: large batches ask for less in all.
BATCH_BYTES, WORDS = 24 << 20, 400_000


def load_ranks(path: str) -> list[bytes]:
    """Tokens by id. Ids are their ranks, gapless from 0."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    out = [b""] * len(ranks)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Vocabulary:
    """Lookups made from the tokens: pairs that merge, single bytes, and the pieces of decoding."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.ranks = tokens, {token: i for i, token in enumerate(tokens)}
        pairs = [(left << int(SHIFT) | right, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.made = np.array([r for _, r in pairs] or [NONE], np.int32)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE if there is none (tokens below 0 never merge)."""
        key = left.astype(np.int64) << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.sum())
        token = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1)).astype(np.int32)
        starts = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        after = np.arange(1, n + 2, dtype=np.int64)
        before = np.arange(-1, n, dtype=np.int64)
        filled = size > 0
        after[(starts + size - 1)[filled]] = n  # n: a place that holds no token
        before[starts[filled]] = n
        pair = np.append(self.rank(token[:-1], token[np.minimum(after[:-1], n)]), NONE).astype(np.int32)
        index: dict[int, list] = defaultdict(list)
        order = np.argsort(pair[:n], kind="stable")
        ranks, first = np.unique(pair[:n][order], return_index=True)
        for r, part in zip(ranks.tolist(), np.split(order, first[1:]) if n else [], strict=True):
            if r != NONE:
                index[r].append(part)
        heap = list(index)
        heapq.heapify(heap)

        def enter(spot: np.ndarray, made: np.ndarray) -> None:
            """New pairs at spots, of ranks made, go into the index."""
            good = np.flatnonzero((made != NONE) & (spot < n))
            if len(good) > 1:
                good = good[np.lexsort((spot[good], made[good]))]
            spot, made = spot[good], made[good]
            if len(spot) > 1 and (twice := np.append(False, spot[1:] == spot[:-1])).any():
                spot, made = spot[~twice], made[~twice]
            edges = np.flatnonzero(np.append(True, made[1:] != made[:-1]))[: len(made)].tolist()
            for q, a, b in zip(made[edges].tolist(), edges, [*edges[1:], len(made)], strict=False):
                if q not in index:
                    heapq.heappush(heap, q)
                index[q].append(spot[a:b])

        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == r]
            if len(at) > 1 and (met := after[at[:-1]] == at[1:]).any():
                # Pairs that overlap: of each run of them every other one, from the left.
                run = np.append(0, np.cumsum(~met))
                place = np.arange(len(at)) - np.flatnonzero(np.append(True, ~met))[run]
                at = at[place % 2 == 0]
            if len(at) > 1 and (again := np.append(False, word[at[1:]] == word[at[:-1]])).any():
                # Several in one word: at once, unless one of them would make a pair that goes before the others.
                gone = after[at]
                made = np.full(len(at), r, np.int32)
                soon = (self.rank(made, token[after[gone]]) < r) | (self.rank(token[before[at]], made) < r) | (self.rank(made, made) < r)
                late = again & np.isin(word[at], word[at[soon]]) if soon.any() else soon
                if late.any():
                    index[r].append(at[late])
                    heapq.heappush(heap, r)
                    at = at[~late]
            if not len(at):
                continue
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], token[gone], after[at], pair[gone] = r, -1, right, NONE
            before[right] = at
            left = before[at]  # that of a neighbour merged just now has moved
            spot = np.concatenate([at, left])
            made = self.rank(token[spot], token[np.concatenate([after[at], at])])
            pair[spot] = made
            pair[n], before[n] = NONE, n
            enter(spot, made)
        live = token[:n] >= 0
        return token[:n][live], np.bincount(word[live], minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = len(self)
        return value


def pieces(part: pa.Table, text: str, pattern: regex.Pattern, ranks: dict[bytes, int]) -> tuple[pa.Table, pa.Table]:
    """What a batch of texts is staged as. First: the ids of its rows and, in a last row (without an id), how many pieces
    each text has, the numbers of its pieces, and of each distinct piece the id if it is a token, else -1. Second: the
    distinct pieces that are no tokens, by key.

    Pieces are numbered by the binary magnitude of their counts, frequent ones first, tokens before others and those by
    key: so the numbers pack well, and the magnitudes by key tell which number a piece of the second table has.
    """
    numbers = _Numbers()
    get, find = numbers.__getitem__, pattern.findall
    own = [np.fromiter(map(get, find(x or "")), np.int32) for x in part.column(text).to_pylist()]
    flat = np.concatenate([*own, np.empty(0, np.int32)])
    words = [w.encode() for w in numbers]
    known = np.array([ranks.get(w, -1) for w in words], np.int32)  # a word that is a token stays whole
    level = np.frexp(np.bincount(flat, minlength=len(words)))[1].astype(np.uint8)
    rest = np.flatnonzero(known < 0)
    rest = rest[keyed([words[i] for i in rest.tolist()])[1]]
    order = np.concatenate([np.flatnonzero(known >= 0), rest])
    order = order[by_level(level[order])]
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    texts = batches.pack_arrays([np.array([len(x) for x in own], "<u4"), *planes(number[flat]), known[order], level[rest]])
    others = batches.pack_arrays([np.array([*(words[i] for i in rest.tolist()), b""], object)[:-1]])
    ids = part.column("doc")
    first = pa.table({"doc": pa.chunked_array([*ids.chunks, pa.nulls(1, ids.type)]), "data": pa.array([None] * len(ids) + [texts], pa.binary())})
    return first, pa.table({"data": pa.array([others], pa.binary())})


def by_level(level: np.ndarray) -> np.ndarray:
    return np.argsort(-level.astype(np.int16), kind="stable")


def unstaged(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of each row, all pieces, tokens of the distinct ones, magnitudes by key of those that are none."""
    rows, *own, known, level = batches.unpack_arrays(part.column("data")[-1].as_py(), ["<u4", *["u1"] * 4, "<i4", "u1"])
    return rows, np.stack(own, axis=1).view("<i4")[:, 0], known, level


def others(part: pa.Table) -> np.ndarray:
    """The distinct pieces of a batch that are no tokens, by key."""
    return batches.unpack_arrays(part.column("data")[0].as_py(), ["O"])[0]


def planes(x: np.ndarray) -> list[np.ndarray]:
    """The four bytes of each number apart, lowest first."""
    return list(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T))


def keyed(words: np.ndarray | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of distinct words in ascending order, and that order."""
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(keys, kind="stable")
    return keys[order], order


class Merging:
    """Ids of words: every distinct word of the corpus is encoded once, in the bucket of its key."""

    kinds = ["O"]

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens

    def keys_of(self, part: pa.Table, role: int) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        words = others(part)
        return [(0, keyed(words)[0], [words])]

    def merge(self, met: batches.Requests) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        numbers = _Numbers()
        place = np.fromiter(map(numbers.__getitem__, met.extra[0]), np.int64, len(met.keys))
        words = np.array([*numbers, b""], object)[:-1]
        keys, order = keyed(words)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return back[place], keys, [words[order]]

    def reply(self, met: batches.Requests, kind: int) -> Iterator[tuple[int, bytes]]:
        inverse, _, (words,) = self.merge(met)
        ids, n = vocabulary_of(self.tokens).encode_words(words.tolist())
        begin = np.cumsum(n) - n
        for i, own in met.each(inverse):
            yield i, batches.pack_arrays([n[own].astype("<u4"), gathered(ids, begin[own], n[own])])

    def pick(self, answers: list[tuple[bytes, int]], places: np.ndarray, role: int) -> bytes:
        n, ids = (np.concatenate(x) for x in zip(*(batches.unpack_arrays(x, ["<u4", "<i4"]) for x, _ in answers), strict=True))
        n = n.astype(np.int64)
        return batches.pack_arrays([n[places].astype("<u4"), gathered(ids, (np.cumsum(n) - n)[places], n[places])])


def gathered(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at `begin` and are n long, one after another."""
    ends = np.cumsum(n)
    return flat[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def sizes(known: np.ndarray, level: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct piece's ids begin, how many they are, and all of them one after another; n and ids are those of
    the pieces that are no tokens, by key.
    """
    back, n = by_level(level), n.astype(np.int64)
    n, ids = n[back], gathered(ids, (np.cumsum(n) - n)[back], n[back])
    size = np.ones(len(known), np.int64)
    size[known < 0] = n
    flat = np.empty(int(size.sum()), np.int32)
    whole = np.repeat(known >= 0, size)
    flat[whole], flat[~whole] = known[known >= 0], ids
    return np.cumsum(size) - size, size, flat


def encode_texts(texts: list[str], vocabulary: Vocabulary, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text (without Spark)."""
    first, second = pieces(pa.table({"doc": pa.nulls(len(texts), pa.int64()), "text": pa.array(texts, pa.string())}), "text", pattern, vocabulary.ranks)
    rows, flat, known, level = unstaged(first)
    ids, n = vocabulary.encode_words(others(second).tolist())
    begin, size, every = sizes(known, level, n, ids)
    ends = np.cumsum(np.append(0, size[flat]))[np.cumsum(np.append(0, rows))]
    return gathered(every, begin[flat], size[flat]), np.diff(ends)


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode's property, as the reference library's regular expressions have it."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


_made: dict[tuple[int, bytes], Vocabulary] = {}


def vocabulary_of(tokens: list[bytes]) -> Vocabulary:
    """The lookups, made once in a worker process."""
    key = (len(tokens), hashlib.sha256(b"\0".join(tokens)).digest())
    if key not in _made:
        _made.clear()
        _made[key] = Vocabulary(tokens)
    return _made[key]


def tokenize(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, fan: int = batches.FAN) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256, and with keep_ids
    also `ids`.
    """
    tokens = load_ranks(path)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(frames, "text", BATCH_BYTES):
            batch = uuid.uuid4().int >> 65
            data = [batches.pack(x) for x in pieces(part, "text", compiled(pattern), vocabulary_of(tokens).ranks)]
            yield pa.RecordBatch.from_arrays([pa.array([batch] * 2, pa.int64()), pa.array([0, 1], pa.int32()), pa.array(data, pa.binary())], ["batch", "role", "data"])

    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/bpe-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        staged = docs.select(named(doc_id).alias("doc"), named(text).alias("text")).mapInArrow(run, batches.STAGED)
        staged.write.option("compression", "none").partitionBy("role").parquet(path)

    def of_role(role: int) -> DataFrame:
        return spark.read.schema(batches.STAGED).parquet(path).where(F.col("role") == role).select("batch", "role", "data")

    words = of_role(1)
    replies = batches.count(words, Merging(tokens), batches.plan(words, WORDS, fan=fan), "bpe-words")
    remove(spark, f"{path}/role=1")  # the words are in the replies now

    def use(part: pa.Table, role: int, got: dict[int, bytes]) -> pa.Table:
        rows, flat, known, level = unstaged(part)
        answers = [batches.unpack_arrays(got[b], ["<u4", "<i4"]) for b in sorted(got)]
        n, ids = (np.concatenate(x) for x in zip([np.empty(0, np.int64), np.empty(0, np.int32)], *answers, strict=True))
        begin, size, every = sizes(known, level, n, ids)
        out, at = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}, 0
        for k in rows.tolist():
            own = flat[at : at + k]
            at += k
            ids = gathered(every, begin[own], size[own])
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids.tolist()))).hexdigest())
            out["ids"].append(ids if keep_ids else None)
        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32())}
        return pa.table({"doc": part.column("doc")[:-1], **{c: pa.array(x, kinds[c]) for c, x in out.items() if keep_ids or c != "ids"}})

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return batches.finish(of_role(0), replies, use, schema).withColumnRenamed("doc", doc_id)
