"""Benchmark decontamination: BM25 retrieval of test items by every training passage, then verification.

Test items are indexed by term; a posting holds the item's BM25 impact divided by the item's own threshold, a share of
the score that the item gives itself, so that 1 is the threshold of every item. Items of like length (to a power of two
of words) share an index, whose items stand in blocks with their maximal impacts, and every document is cut for it into
overlapping passages twice as long as its items may be: the passages that an item is looked for in depend on its own
length only. A passage is a query of its distinct terms. Blocks whose maxima sum to less than 1 are skipped (for all
passages of a chunk at once); what is left goes through block-max WAND, which returns every item above the threshold. A
retrieved item counts as a leak if the passage also holds enough of the word pairs of its question and of its answer.

An item's answer is what follows a line mark such as "Answer:", else its last sentence; the rest is its question (an
item of one sentence is both). Nothing is capped: all passages of all documents are queried, all items above the
threshold verified. Document frequencies are those of all items. Items come to the driver in shards of bounded size, one
at a time: a benchmark of several shards takes a pass over the documents for each, whose result is written before the
next is read.

Null and empty texts have no passages; null or wordless items match nothing; texts may be of any length. Of items with one
id each document has one row. Repeated rows of documents are found each. An empty table of either kind gives an empty
result (and filters nothing). Only the columns named are read, and documents' columns of any name are carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, filter_rows, materialise, named, text_bytes

SHARD_CHARS = 8_000_000  # of items in one shard: bounds what a task holds of them
SHARE, OVERLAP = 0.6, 0.7
K1, B, BLOCK, CACHE, MATRIX, SHORTEST = 1.2, 0.75, 4, 250_000, 4_000_000, 16
EDGE = re.compile(r"^\W+|\W+$")


def normal(word: bytes) -> str:
    """Lower case without punctuation at the ends."""
    return EDGE.sub("", word.decode("utf-8", "replace").lower())


def terms(text: bytes) -> list[str]:
    return [t for t in map(normal, text.split()) if t]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    marked = re.split(r"(?im)^\s*(?:answer|a|antwort|réponse|respuesta)\s*:\s*", text, maxsplit=1)
    if len(marked) == 2 and marked[0].strip() and marked[1].strip():
        return marked[0], marked[1]
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    tail = len(parts) - 1
    while tail > 0 and len(terms(" ".join(parts[tail:]).encode())) < 3:  # an answer of one or two words proves little
        tail -= 1
    return (" ".join(parts[:tail]), " ".join(parts[tail:])) if tail > 0 else (text, text)


def pairs(words: list) -> set:
    return set(zip(words, words[1:], strict=False)) or set(words)


def length_class(words: int) -> int:
    """The least power of two (SHORTEST at least) that is no less than the number of words."""
    return max(SHORTEST, 1 << (words - 1).bit_length())


class Index:
    """Inverted index of the items of one shard and length class: (id, terms, text); `span` is the longest they may be."""

    def __init__(self, texts: list[tuple], span: int, df: dict[str, int], total: int, mean: float):
        self.ids = [i for i, _, _ in texts]
        self.parts = [tuple(pairs(terms(p.encode())) for p in split_item(t)) for _, _, t in texts]
        self.span = span
        self.numbers: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for item, (_, words, _) in enumerate(texts):
            impact = {}
            for t, tf in Counter(words).items():
                idf = np.log1p((total - df.get(t, 1) + 0.5) / (df.get(t, 1) + 0.5))
                impact[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            threshold = SHARE * sum(impact.values())
            for t, x in impact.items():
                n = self.numbers.setdefault(t, len(self.numbers))
                if n == len(postings):
                    postings.append([])
                postings[n].append((item, x / threshold))
        self.docs = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        # Maxima of every block that a term occurs in, and of groups of blocks in a matrix of bounded size.
        self.blocks = [sorted({item // BLOCK for item in own}) for own in self.docs]
        self.maxima = []
        blocks = max(-(-len(texts) // BLOCK), 1)
        self.group = -(-blocks // max(1, min(blocks, MATRIX // max(len(postings), 1))))
        self.bounds = np.zeros((len(postings), -(-blocks // self.group)), np.float32)
        for n, p in enumerate(postings):
            most: dict[int, float] = {}
            for item, x in p:
                most[item // BLOCK] = max(most.get(item // BLOCK, 0.0), x)
            self.maxima.append([most[k] for k in self.blocks[n]])
            for k, x in most.items():
                self.bounds[n, k // self.group] = max(self.bounds[n, k // self.group], np.float32(x) * np.float32(1.000001))
        self.most = [max(x) for x in self.impacts]

    def hopeful(self, term: np.ndarray, window: np.ndarray, windows: int) -> np.ndarray:
        """Which windows have a block whose maxima sum to 1 or more; (window, term) in order and distinct."""
        out = np.zeros(windows, bool)
        first = np.append(np.flatnonzero(np.append(True, window[1:] != window[:-1])), len(window)) if len(window) else np.zeros(1, np.int64)
        most, a = max(MATRIX // self.bounds.shape[1], 1), 0  # pairs whose bounds are gathered at once
        while a < len(first) - 1:
            b = max(int(np.searchsorted(first, first[a] + most, side="right")) - 1, a + 1)
            if first[b] - first[a] <= most:
                sums = np.add.reduceat(self.bounds[term[first[a] : first[b]]], first[a:b] - first[a], axis=0)
            else:  # one window of many terms
                sums = sum(self.bounds[term[k : min(k + most, first[b])]].sum(0) for k in range(first[a], first[b], most))[None, :]
            out[window[first[a:b]]] = sums.max(1) >= 0.9999
            a = b
        return out

    def wand(self, query: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """Items that score `threshold` or more for the distinct terms of a query, by block-max WAND."""
        cursors = [[self.docs[t][0], 0, t] for t in query]  # item, place in the posting list, term
        found, end = [], len(self.ids)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most(t, block) for _, _, t in cursors[: pivot + 1]) < threshold - 1e-6:
                # Nothing before the block's end, or before the next cursor, can reach the threshold.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                self._move(cursors, pivot + 1, max(target, item + 1) if target <= item else target, end)
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][at] for _, at, t in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                self._move(cursors, pivot + 1, item + 1, end)
            else:
                self._move(cursors, pivot, item, end)
        return found

    def block_most(self, term: int, block: int) -> float:
        at = bisect_left(self.blocks[term], block)
        return self.maxima[term][at] if at < len(self.blocks[term]) and self.blocks[term][at] == block else 0.0

    def _move(self, cursors: list, n: int, target: int, end: int) -> None:
        """Move the first n cursors to the first posting of target or later; drop those at their end."""
        for c in cursors[:n]:
            if c[0] < target:
                c[1] = bisect_left(self.docs[c[2]], target, c[1])
                c[0] = self.docs[c[2]][c[1]] if c[1] < len(self.docs[c[2]]) else end
        cursors[:] = [c for c in cursors if c[0] < end]


class Shard:
    """The indexes of one shard's items (id, text), one for each length class that occurs."""

    def __init__(self, items: list[tuple], df: dict[str, int], total: int, mean: float):
        classes: dict[int, list] = {}
        for i, t in items:
            if words := terms((t or "").encode()):
                classes.setdefault(length_class(len(words)), []).append((i, words, t))
        self.indexes = [Index(own, span, df, total, mean) for span, own in sorted(classes.items())]
        self.numbers: dict[str, int] = {}
        for index in self.indexes:
            for term in index.numbers:
                self.numbers.setdefault(term, len(self.numbers))
        self.local = []  # of each index: its number of each term of the shard, -1 where it has none
        for index in self.indexes:
            own = np.full(len(self.numbers) + 1, -1, np.int64)
            for term, n in index.numbers.items():
                own[self.numbers[term]] = n
            self.local.append(own)


class _Numbers(dict):
    """Term numbers of words as they stand; -1 for those of no item."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        value = self.numbers.get(normal(word), -1)
        if len(self) < CACHE:
            self[word] = value
        return value


def search(texts: list[bytes], shard: Shard, numbers: _Numbers) -> list[list[tuple]]:
    """For each text: (item id, BM25 as a share of the item's own, question overlap, answer overlap, first word)."""
    words = [x.split() for x in texts]
    size = np.array([len(w) for w in words], np.int64)
    term = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
    out: list[list[tuple]] = [[] for _ in texts]
    every = np.flatnonzero(term >= 0)
    begin = np.cumsum(size) - size
    for index, local in zip(shard.indexes, shard.local, strict=True):
        own = local[term[every]]
        hit, own = every[own >= 0], own[own >= 0]
        if len(hit):
            _search(words, size, begin, hit, own, index, out)
    for own_hits in out:  # the best passage of each item
        best: dict = {}
        for h in own_hits:
            if h[0] not in best or h[1:4] > best[h[0]][1:4]:
                best[h[0]] = h
        own_hits[:] = [best[k] for k in sorted(best)]
    return out


def _search(words: list[list[bytes]], size: np.ndarray, begin: np.ndarray, hit: np.ndarray, term: np.ndarray, index: Index, out: list[list[tuple]]) -> None:
    """Adds what an index finds; hit: places of its terms among all words."""
    step = index.span
    per = np.maximum(-(-size // step) - 1, (size > 0).astype(np.int64))  # windows of 2 x step, a step apart
    base = np.cumsum(per) - per
    text = np.searchsorted(begin + size, hit, side="right")
    place = (hit - begin[text]) // step
    last = per[text] - 1
    many = len(index.docs)
    keys = np.sort(np.concatenate([(base[text] + np.clip(w, 0, last)) * many + term for w in (place - 1, place)]))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    window, own = keys // many, keys % many
    for w in np.flatnonzero(index.hopeful(own, window, int(per.sum()))).tolist():
        a, b = np.searchsorted(window, [w, w + 1])
        found = index.wand(own[a:b].tolist())
        if found:
            i = int(np.searchsorted(base + per, w, side="right"))
            first = int(w - base[i]) * step
            held = pairs_of([normal(x) for x in words[i][first : first + 2 * step]])
            for item, score in found:
                question, answer = (len(p & held) / len(p) for p in index.parts[item])
                if question >= OVERLAP and answer >= OVERLAP:
                    out[i].append((index.ids[item], float(score * SHARE), question, answer, first))


def pairs_of(words: list[str]) -> set:
    """Word pairs and words of a passage."""
    words = [w for w in words if w]
    return {*zip(words, words[1:], strict=False), *words}


def shards(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", shard_chars: int = SHARD_CHARS) -> tuple[int, Iterator[Shard]]:
    """How many shards there are, and each, one after another; statistics are those of all items."""
    items = benchmark.where(named(text).isNotNull() & named(item_id).isNotNull()).select(named(item_id).alias("item"), named(text).alias("text"))

    def counted(frames):
        for frame in frames:
            own = [terms(t.encode()) for t in frame["text"]]
            yield frame.assign(terms=[sorted(set(w)) for w in own], n=[len(w) for w in own])[["terms", "n"]]

    stats = items.mapInPandas(counted, "terms array<string>, n bigint").where("n > 0")
    row = stats.agg(F.count("*").alias("total"), F.avg("n").alias("mean")).first()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-chars // shard_chars)) if row["total"] else 0
    df = stats.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def each() -> Iterator[Shard]:
        for s in range(many):
            own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == s)
            held = sorted((r["item"], r["text"]) for r in own.toLocalIterator())
            used = own.mapInPandas(counted, "terms array<string>, n bigint").select(F.explode("terms").alias("term")).distinct()
            yield Shard(held, {r["term"]: r["df"] for r in df.join(used, "term").toLocalIterator()}, row["total"], row["mean"])

    return many, each()


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id, bm25_share, question_overlap, answer_overlap, first_word): a row for each leak."""
    kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    schema = f"id {kind}, item {item_kind}, bm25_share double, question_overlap double, answer_overlap double, first_word int"
    rows = docs.select(named(doc_id).alias("id"), named(text).alias("text"))

    def scan(shard: Shard):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = _Numbers(shard.numbers)
            for part in chunks(batches, "text", 4 << 20):
                found = search(text_bytes(part.column("text")), shard, numbers)
                which = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
                if len(which):
                    columns = zip(*(h for own in found for h in own), strict=True)
                    kinds = (item_type, pa.float64(), pa.float64(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks().take(which), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "item", "bm25_share", "question_overlap", "answer_overlap", "first_word"])

        return run

    many, each = shards(benchmark, item_id, item_text, shard_chars)
    found = [own if many == 1 else materialise(own, "leaks") for own in (rows.mapInArrow(scan(shard), schema) for shard in each)]
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": doc_id, "item": "item_id"})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of docs, all columns, that hold no test item."""

    def keep(shard: Shard):
        def start():
            numbers = _Numbers(shard.numbers)
            return lambda texts: np.array([not own for own in search(texts, shard, numbers)], bool)

        return start

    many, each = shards(benchmark, item_id, item_text, shard_chars)
    for shard in each:
        docs = filter_rows(docs, text, keep(shard))
        docs = docs if many == 1 else materialise(docs, "no-leaks")
    return docs
