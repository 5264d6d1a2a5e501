"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts in a document with a smaller id go.

A suffix array of everything would move `length` bytes for each byte of text. So suffixes are sampled by their content:
of the strings of GRAM bytes in every window of `length` bytes, the one of least hash is the window's anchor, and equal
windows have equal anchors. Consecutive windows of one anchor travel as one record, the stretch of text that they span
(some 67 bytes for 18 windows), with the least id of the documents of a batch that hold it. Before they do, hashes of the
stretches around anchors are counted over the corpus: records that share none with another have no repeated window, and stay.

Records are range-partitioned by the leading bytes of the suffix at their anchor: sampled splitters cut the order into
RANGES ranges of about equal weight, and buckets inside a range part by the whole leading string, so that equal windows
meet. A bucket sorts what it holds by multikey quicksort, eight bytes at a time, among the entries still tied only: first
whole records (equal ones need no further comparison), then, where an anchor's string has several records, the suffixes at
each of their windows. Where adjacent suffixes share `length` bytes, the least id wins; the others' windows go. No match
crosses the boundary of a bucket unless its anchor's leading string is frequent. Such strings (HOT records or more, as a
sample of all records tells; the most frequent LISTED of them, so that what is broadcast is bounded, and any other holds
at most the LISTED-th part of all records) are compared across boundaries: their windows part again, each by all of its
bytes, and meet in buckets of their own. How records travel changes no result, all comparisons are of whole strings.

A batch sends equal records once, so that a passage in a third of all documents is one record a batch; requests and
answers are those of `batches`.

Defined cases: null texts are empty; texts shorter than `length` stay whole; null ids neither lose bytes nor make others
lose any; rows with equal ids are one document in this respect. Ids are integers (any other type is a ValueError). Texts
are handled in stretches, so their length is not bounded by memory beyond one text. An empty table gives an empty result.
Carried columns keep their names; the results come in one struct, whose name gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import batches, substring
from .common import discard, free_name, materialise, mix, named, text_bytes, tidy

LENGTH = 50
GRAM = 16
WIDE = 88  # bytes kept for a record, in words of eight
STRETCH = 1 << 18  # windows looked at together: what numpy holds of them stays in the processor's cache
RANGES, RANGE_BITS = 4096, 12
SAMPLE_BITS = 8  # of 2^8 records one is in the sample
HOT, LISTED = 1 << 17, 1 << 20
NOBODY = np.iinfo(np.int64).max

_MASKS = np.array([(1 << 64) - (1 << 8 * (8 - k)) if k else 0 for k in range(9)], np.uint64)  # the first k of eight bytes


def multikey_order(group: np.ndarray, word: Callable[[np.ndarray, int], np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts entries by group and then by their words; `word(entries, k)` gives word k of entries.

    Returns the order and, for each place in it, whether the entry equals the one before. Each pass sorts the entries
    that are tied so far, within their ties.
    """
    order = np.argsort(group, kind="stable")
    same = np.append(False, group[order][1:] == group[order][:-1])[: len(order)]
    for k in range(words):
        tied = same | np.append(same[1:], False)[: len(same)]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        rank = np.cumsum(~same[at])
        value = word(own, k)
        by = np.lexsort((value, rank))
        order[at] = own[by]
        value, rank = value[by], rank[by]
        same[at] = np.append(False, (value[1:] == value[:-1]) & (rank[1:] == rank[:-1]))
    return order, same


def least_by_run(values: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each place the least value of its run of equal entries."""
    if not len(values):
        return values
    starts = np.flatnonzero(~same)
    return np.repeat(np.minimum.reduceat(values, starts), np.diff(np.append(starts, len(values))))


def _grams(eight: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of GRAM bytes that begin at each place."""
    return mix(eight[: len(eight) - 8] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[8:] + np.uint64(0x632BE59BD9B4E019)))


def _anchors(h: np.ndarray, count: int, length: int) -> np.ndarray:
    """For each of `count` windows the place of its anchor: the leftmost gram of least hash."""
    wide = length - GRAM + 1
    least = (h[: count + wide - 1] >> np.uint64(32) << np.uint64(32)) | np.arange(count + wide - 1, dtype=np.uint64)
    step = 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[: count], least[wide - step : wide - step + count])
    return (least[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Records:
    """Records of a batch: key (of the anchor's string), lead (its first eight bytes), windows, bytes, id of the document,
    and where the first window is in the batch.
    """

    key: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    lead: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    n: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))
    data: np.ndarray = field(default_factory=lambda: np.empty((0, WIDE), np.uint8))
    doc: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    start: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def pick(self, at: np.ndarray) -> Records:
        return Records(self.key[at], self.lead[at], self.n[at], self.data[at] if len(self.data) else self.data, self.doc[at], self.start[at])

    @staticmethod
    def join(parts: list[Records]) -> Records:
        return Records(*[np.concatenate(x) for x in zip(*[(p.key, p.lead, p.n, p.data, p.doc, p.start) for p in parts], strict=True)]) if parts else Records()


def _bytes_at(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`size` bytes from each start, zeros after them, in rows of WIDE bytes."""
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    out = np.empty((len(start), WIDE // 8), "<u8")
    for k in range(WIDE // 8):
        left = np.clip(size - 8 * k, 0, 8)
        full = (np.uint64(1) << (left.astype(np.uint64) % np.uint64(8) * np.uint64(8))) - np.uint64(1)
        out[:, k] = eight[np.minimum(start + 8 * k, len(eight) - 1)] & np.where(left == 8, np.uint64(2**64 - 1), full)
    return out.view(np.uint8)


def _word(data: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    wide = data.view(">u8")
    return lambda own, k: wide[own, k].astype(np.uint64)


def _hash_rows(data: np.ndarray) -> np.ndarray:
    wide, h = data.view("<u8"), np.zeros(len(data), np.uint64)
    for k in range(wide.shape[1]):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) ^ wide[:, k])
    return h


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another with room behind, and where each ends."""
    return np.frombuffer(b"".join([*texts, bytes(WIDE + 8)]), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _hash_at(buffer: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` bytes at each start."""
    eight, h = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,)), np.full(len(start), size, np.uint64)
    for k in range(0, size, 8):
        value = eight[start + k]
        h = mix(h * np.uint64(0x9FB21C651E98DF25) ^ (value if size - k >= 8 else value & np.uint64((1 << 8 * (size - k)) - 1)))
    return h


def scan(buffer: np.ndarray, ends: np.ndarray, ids: np.ndarray, length: int) -> tuple[Records, np.ndarray]:
    """Records, still without bytes, of the windows of the texts whose id isn't NOBODY; and the two keys of each.

    A window begins `half` bytes or more before its anchor, or fewer. Two equal windows agree in that, so they agree in the
    `half` bytes before the anchor and its string, or in the string and what follows it up to length - half + 1 bytes. A
    record whose stretches of this kind occur nowhere else has no window that does. Zero stands for a stretch that no
    window of the record has.
    """
    half = max((length - GRAM + 1) // 2, 1)
    total = int(ends[-1]) if len(ends) else 0
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    parts, keys = [Records()], [np.empty((0, 2), np.uint64)]
    for a in range(0, max(total - length + 1, 0), STRETCH):
        count = min(STRETCH, total - length + 1 - a)
        owner = np.searchsorted(ends, [a, a + count - 1], side="right")
        fits = np.diff(np.clip(np.append(a, ends[owner[0] : owner[1] + 1]), a, a + count))  # windows that begin in each text
        doc = np.repeat(np.arange(owner[0], owner[1] + 1), fits)
        valid = (np.arange(a, a + count) + length <= ends[doc]) & (ids[doc] != NOBODY)
        if not valid.any():
            continue
        h = _grams(eight[a : a + count + length - 1])
        anchor = _anchors(h, count, length)
        first = np.flatnonzero(valid & ~np.append(False, valid[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1])))
        n = np.add.reduceat(valid, first).astype(np.int64)
        at = anchor[first]
        parts.append(Records(h[at], eight[a + at].byteswap(), n.astype(np.uint8), np.empty((0, WIDE), np.uint8), ids[doc[first]], first + a))
        own, before, after = np.zeros((len(first), 2), np.uint64), at - first >= half, at - first - n + 1 < half
        own[before, 0] = _hash_at(buffer, a + at[before] - half, half + GRAM)
        own[after, 1] = _hash_at(buffer, a + at[after], length - half + 1)
        keys.append(own)
    return Records.join(parts), np.concatenate(keys)


def filled(buffer: np.ndarray, r: Records, length: int, hot: np.ndarray) -> Records:
    """The records with their bytes; those of hot keys window by window, each under a key of all of its bytes."""
    often = np.isin(r.key, hot) if len(hot) else np.zeros(len(r.key), bool)
    i, rest = np.flatnonzero(often), np.flatnonzero(~often)
    n = r.n.astype(np.int64)
    out = [Records(r.key[rest], r.lead[rest], r.n[rest], _bytes_at(buffer, r.start[rest], n[rest] + length - 1), r.doc[rest], r.start[rest])]
    if len(i):
        each = np.repeat(i, n[i])
        begin = r.start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
        data = _bytes_at(buffer, begin, np.full(len(each), length))
        key = _hash_rows(data)
        out.append(Records(key, key, np.ones(len(each), np.uint8), data, r.doc[each], begin))
    return Records.join(out)


def distinct(r: Records) -> tuple[np.ndarray, np.ndarray]:
    """The place in r of one of each kind of record (of the least id, if equal records were found), and each record's kind.

    Records are compared whole next to each other in the order of their hashes; a missed pair is two kinds, no error.
    """
    order = np.lexsort((r.doc, _hash_rows(r.data) ^ r.n.astype(np.uint64)))
    data, n = r.data[order].view("<u8"), r.n[order]
    same = np.append(False, (data[1:] == data[:-1]).all(1) & (n[1:] == n[:-1]))[: len(order)]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~same) - 1
    return order[~same], kind


class Shared(substring.Repeats):
    """Which stretches around anchors occur twice or more in the corpus: a bit for each (a hash met by chance is one more)."""

    def __init__(self, text: str, doc: str, length: int):
        self.text, self.doc, self.length = text, doc, length

    def keys_of(self, part: pa.Table, role: int) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        keys, counts = np.unique(scan(*texts_of(part, self.text, self.doc), self.length)[1], return_counts=True)
        keys, counts = (keys[1:], counts[1:]) if len(keys) and keys[0] == 0 else (keys, counts)
        return [(0, keys, [np.zeros(len(keys), "<u4"), (counts > 1).astype(np.uint8)])]


def texts_of(part: pa.Table, text: str, doc: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, ends and ids of a batch's texts."""
    return *joined(text_bytes(part.column(text))), part.column(doc).fill_null(NOBODY).to_numpy().astype(np.int64)


@dataclass
class Plans:
    """How the two questions travel, and what the second one sorts by."""

    shared: batches.Plan
    matches: batches.Plan
    splitters: np.ndarray
    hot: np.ndarray


def prepared(part: pa.Table, text: str, doc: str, length: int, how: Plans, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, Records, np.ndarray, np.ndarray]:
    """Buffer and ends of a batch's texts, its records that share a stretch with others (got: the answers of Shared, by
    bucket), which of them are sent, and each record's kind.
    """
    buffer, ends, ids = texts_of(part, text, doc)
    r, stretches = scan(buffer, ends, ids, length)
    keys = np.unique(stretches)
    keys = keys[1:] if len(keys) and keys[0] == 0 else keys
    at, bits = how.shared.cut(keys), [keys[:0]]
    for bucket, data in got.items():
        own = keys[at[bucket] : at[bucket + 1]]
        bits.append(own[np.unpackbits(np.frombuffer(data, np.uint8), count=len(own)).astype(bool)])
    r = filled(buffer, r.pick(np.flatnonzero(np.isin(stretches, np.concatenate(bits)).any(1))), length, how.hot)
    first, kind = distinct(r)
    return buffer, ends, r, first, kind


def route(key: np.ndarray, lead: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The number by which a record travels: the range of its leading bytes, then the hash of the anchor's string."""
    own = np.searchsorted(splitters, lead, side="right").astype(np.uint64)
    return own << np.uint64(64 - RANGE_BITS) | key >> np.uint64(RANGE_BITS)


def flags(data: np.ndarray, n: np.ndarray, doc: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For each record a mask of its windows that occur in a record of a smaller id among those given."""
    out = np.zeros(len(key), np.uint64)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    met = np.flatnonzero(count[inverse] > 1)
    if not len(met):
        return out
    every = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    # Whole records. Their windows' number goes before their bytes; the rest of a row is zero.
    word = _word(data)
    order, same = multikey_order(inverse[met], lambda own, k: n[met[own]].astype(np.uint64) if k == 0 else word(met[own], k - 1), WIDE // 8 + 1)
    own = met[order]
    least = least_by_run(doc[own], same)
    later = doc[own] > least
    out[own[later]] = every[own[later]]
    # One record of each kind goes on, where its anchor's string has several kinds.
    kinds = own[~same]
    firsts = least[~same]
    group = inverse[kinds]
    several = np.bincount(group)[group] > 1
    kinds, firsts, group = kinds[several], firsts[several], group[several]
    found = _window_flags(data[kinds], n[kinds], firsts, group, length)
    # All records of that kind and least id take its answer.
    answer = np.zeros(len(key), np.uint64)
    answer[kinds] = found
    spread = np.repeat(answer[own[~same]], np.diff(np.append(np.flatnonzero(~same), len(own))))
    out[own[~later]] = spread[~later]
    return out


def _window_flags(data: np.ndarray, n: np.ndarray, doc: np.ndarray, group: np.ndarray, length: int, most: int = 1 << 21) -> np.ndarray:
    """As flags, for distinct records, comparing the suffixes at every window; groups one after another, some at a time."""
    out = np.zeros(len(n), np.uint64)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(n[order].astype(np.int64))
    edge = np.flatnonzero(np.append(group[order][1:] != group[order][:-1], True)) + 1 if len(order) else np.empty(0, np.int64)
    at = 0
    while at < len(order):
        before = ends[at - 1] if at else 0
        i = np.searchsorted(ends[edge - 1], before + most, side="right")
        end = int(edge[min(max(i - 1, np.searchsorted(edge, at, side="right")), len(edge) - 1)])
        rows = order[at:end]
        at = end
        flat = np.ascontiguousarray(data[rows])
        eight = np.ndarray((flat.size - 7,), ">u8", flat, strides=(1,))
        count = n[rows].astype(np.int64)
        record = np.repeat(np.arange(len(rows)), count)
        window = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        place = record * WIDE + window

        def word(own: np.ndarray, k: int, place=place, eight=eight) -> np.ndarray:
            return eight[np.minimum(place[own] + 8 * k, len(eight) - 1)].astype(np.uint64) & _MASKS[min(8, length - 8 * k)]

        by, same = multikey_order(group[rows][record], word, -(-length // 8))
        own = doc[rows][record][by]
        hit = by[own > least_by_run(own, same)]
        np.bitwise_or.at(out, rows[record[hit]], np.uint64(1) << window[hit].astype(np.uint64))
    return out


class Suffixes:
    """Asks, for each kind of record of a batch, which of its windows start in a document of a smaller id elsewhere."""

    kinds = ["<i8", "|u1", f"|V{WIDE}"]

    def __init__(self, text: str, doc: str, length: int, how: Plans):
        self.text, self.doc, self.length, self.how = text, doc, length, how

    def asked(self, r: Records, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the kinds in ascending order, and the kind at each place."""
        key = route(r.key[first], r.lead[first], self.how.splitters)
        order = np.argsort(key, kind="stable")
        return key[order], order

    def keys_of(self, part: pa.Table, role: int, got: dict[int, bytes]) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        _, _, r, first, _ = prepared(part, self.text, self.doc, self.length, self.how, got)
        key, order = self.asked(r, first)
        own = r.pick(first[order])
        return [(0, key, [own.doc, own.n, _void(own.data)])]

    def reply(self, met: batches.Requests, kind: int) -> Iterator[tuple[int, bytes]]:
        doc, n, data = met.extra
        masks = flags(_rows(data), n, doc, met.keys, self.length)
        for i, own in met.each(masks):
            if own.any():
                yield i, squeeze(own)

    def merge(self, met: batches.Requests) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Equal records become one, of the least id."""
        doc, n, data = met.extra
        r = Records(met.keys, met.keys, n, _rows(data), doc, np.zeros(len(n), np.int64))
        first, kind = distinct(r)
        order = np.argsort(met.keys[first], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        first = first[order]
        return back[kind], met.keys[first], [doc[first], n[first], data[first]]

    def pick(self, answers: list[tuple[bytes | None, int]], places: np.ndarray, role: int) -> bytes | None:
        masks = np.concatenate([np.zeros(n, np.uint64) if x is None else expand(x) for x, n in answers])[places]
        return squeeze(masks) if masks.any() else None

    def settle(self, picked: bytes | None, met: batches.Requests, i: int, places: np.ndarray, extra: list[np.ndarray]) -> bytes | None:
        """A request whose record has a larger id than the merged one loses all of that record's windows."""
        a, b = met.at[i], met.at[i + 1]
        later = met.extra[0][a:b] > extra[0][places]
        if not later.any():
            return picked
        masks = (np.zeros(b - a, np.uint64) if picked is None else expand(picked)).copy()
        masks[later] = (np.uint64(1) << met.extra[1][a:b][later].astype(np.uint64)) - np.uint64(1)
        return squeeze(masks)


def _void(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view(f"V{WIDE}").ravel()


def _rows(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view(np.uint8).reshape(-1, WIDE)


def squeeze(masks: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(masks.astype("<u8").tobytes())


def expand(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u8")


def _sampled(staged: DataFrame, length: int, bits: int) -> DataFrame:
    """(lead, key) of the records of each batch that are in the sample, chosen by what is around their anchors."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for data in frame.column("data").to_pylist():
                tidy()
                r, stretches = scan(*texts_of(batches.unpack(data), "text", "doc"), length)
                _, first = np.unique(stretches, axis=0, return_index=True)
                own = first[mix(stretches[first].sum(1)) & np.uint64((1 << bits) - 1) == 0]
                yield pa.RecordBatch.from_arrays([pa.array((r.lead[own] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(r.key[own].view(np.int64))], ["lead", "key"])

    return staged.select("data").mapInArrow(run, "lead bigint, key bigint")


def _splitters(staged: DataFrame, length: int, hot_from: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """RANGES - 1 splitters of the leading bytes at most, ascending, and the keys of hot strings, ascending."""
    part = min(bits, 2) if staged.count() >= 64 else 0  # of 2^part batches one is looked at, and fewer of its records pass over
    seen = staged.where(F.pmod("batch", F.lit(1 << part)) == 0)
    sample = materialise(_sampled(seen, length, bits - part), "suffix-sample")
    cut = sample.agg(F.percentile_approx("lead", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(4 * RANGES)).alias("at")).first()["at"]
    often = sample.groupBy("key").count().where(F.col("count") >= max(hot_from >> bits, 2)).orderBy(F.desc("count"), "key").limit(LISTED)
    hot = [r["key"] for r in often.collect()]
    discard(sample)
    return np.unique(np.array(cut or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63)), np.sort(np.array(hot, np.int64).view(np.uint64))


def covered(part: pa.Table, ask: Suffixes, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, where each text ends, and whether each byte is covered.

    got: answers by bucket; those of Shared under -1 - bucket.
    """
    buffer, ends, r, first, kind = prepared(part, ask.text, ask.doc, ask.length, ask.how, {-1 - b: x for b, x in got.items() if b < 0})
    key, order = ask.asked(r, first)
    masks = np.zeros(len(first), np.uint64)
    at = ask.how.matches.cut(key)
    for bucket, data in got.items():
        if bucket >= 0:
            masks[order[at[bucket] : at[bucket + 1]]] = expand(data)
    mask = masks[kind]
    later = r.doc > r.doc[first][kind]
    mask[later] = (np.uint64(1) << r.n[later].astype(np.uint64)) - np.uint64(1)
    size = len(buffer) - WIDE - 8
    edge = np.zeros(size + 1, np.int32)
    live = np.flatnonzero(mask)
    for k in range(int(r.n[live].max()) if len(live) else 0):
        hit = r.start[live[(mask[live] >> np.uint64(k) & np.uint64(1)).astype(bool)]] + k
        edge[hit] += 1  # a window belongs to one record
        edge[hit + ask.length] -= 1
    return buffer[:size], ends, np.cumsum(edge[:-1], dtype=np.int32) > 0


def remove_earlier(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), fan: int = batches.FAN, hot_from: int = HOT, sample_bits: int = SAMPLE_BITS) -> DataFrame:
    """Per row of docs: doc_id, `carry` and a struct `repeats` (underscores before it if a column has that name) of n_bytes,
    removed (maximal intervals of bytes, end exclusive) and kept (the other bytes).
    """
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise ValueError(f"{doc_id} must be of an integer type")
    if not GRAM <= length <= 64 + GRAM - 1 or 2 * length - GRAM > WIDE:
        raise ValueError(f"length must be {GRAM} to {(WIDE + GRAM) // 2}")
    keep = [doc_id, *[c for c in carry if c != doc_id]]
    own = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(doc_id).cast("bigint").alias("doc"), named(text).alias("text"))
    staged = batches.stage(own, "text", "suffixes")
    how = Plans(*[batches.plan(staged, batches.BATCH_BYTES // n, fan=fan) for n in (9, 16)], *_splitters(staged, length, hot_from, sample_bits))
    ask = Suffixes("text", "doc", length, how)
    shared = batches.count(staged, Shared("text", "doc", length), how.shared, "suffix-shared")
    matches = batches.count(staged, ask, how.matches, "suffix-matches", shared)
    replies = matches.unionByName(shared.withColumn("bucket", -1 - F.col("bucket")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def use(part: pa.Table, role: int, got: dict[int, bytes]) -> pa.Table:
        data, ends, gone = covered(part, ask, got)
        spans, kept = [], []
        for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            g = gone[a:b]
            if g.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                spans.append([{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
                kept.append(data[a:b][~g].tobytes())
            else:
                spans.append([])
                kept.append(data[a:b].tobytes())
        sizes = pa.array(np.diff(ends, prepend=0), pa.int64())
        return part.drop_columns(["text", "doc"]).append_column("n_bytes", sizes).append_column("removed", pa.array(spans, span)).append_column("kept", pa.array(kept, pa.binary()))

    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"])
    out = batches.finish(staged, replies, use, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.struct("n_bytes", "removed", "kept").alias(free_name("repeats", keep)))


def kept_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **more: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the kept bytes)."""
    own = remove_earlier(docs.select(named(doc_id).alias("id"), named(text).alias("text")), "id", "text", length, **more)
    r = F.col("repeats")
    removed = F.aggregate(r["removed"], F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return own.select(F.col("id").alias(doc_id), r["n_bytes"].alias("n_bytes"), removed.alias("n_removed"), F.size(r["removed"]).cast("bigint").alias("n_spans"), F.sha2(r["kept"], 256).alias("kept_sha256"))
