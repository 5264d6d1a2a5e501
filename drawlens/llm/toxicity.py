"""Toxicity: a linear-chain conditional random field tags toxic tokens; forward-backward marginals make scores.

The field has two labels; features of the word (its form, prefixes, suffix and shape) and of its neighbours (their
prefixes), transitions and start. All weights are learned together, by the likelihood's gradient: expected less
observed counts of single labels and of pairs, from forward and backward passes.

Labels mark documents, so tokens are labelled in two steps. First a token of a toxic document counts as toxic if its form
or prefix occurs in many toxic documents and hardly in others, every other token as clean, and the field is fitted to
these. Then the document's label alone counts: no token of a clean document is toxic, at least one of a toxic document
is; the observed counts of the latter are those expected under that condition, as the field itself sees them. So what
the list of forms missed, or wrongly held, is settled by the documents. A document's score is a logistic function, fitted
on the same documents, of the expected number of its toxic tokens; tokens whose marginal is at least one half give the
offending offsets.

Fitting uses a bounded number of labelled documents (`toxic`, `clean`: those of least hash among those allowed), each with
its whole text; of a text only the numbers of its words are kept, and gradients are summed over pieces of bounded length.
Scoring covers the whole text of every row. All documents of a piece form one chain whose transfer matrices have rank
one at each document's start, which is exact and lets numpy work on many blocks of the chain at once.

Null and empty texts get the score of no toxic token; texts may be of any length. Without toxic or without clean training
rows every score is 0. Rows with null labels or ids are not learned from; of several labels of one document the largest
counts, of several texts the least. Repeated rows are scored alike. An empty table gives an empty result. Only the columns
named are read, so others can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, filter_rows, named, text_bytes, tidy, Words

#: Documents of either class that the model is fitted on, at most.
TOXIC, CLEAN = 1500, 2500
SLOTS, BLOCK, CACHE, PIECE = 1 << 18, 256, 250_000, 1 << 17
LEAST, ODDS = 5, 20.0  # toxic documents with a form, and how much likelier it is there, to label its tokens
ROUNDS = (20, 8)  # with labelled tokens, and with labelled documents
SLOW = 1.0  # squared gradient that a weight begins with, so that rare features move little
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def forms(word: bytes) -> tuple[str, ...]:
    """The form and the prefixes that labels are found by."""
    w = word.decode("utf-8", "replace").strip(STRIP).lower()
    return (w, *(f"{w[:k]}*" for k in (4, 5) if len(w) > k))


@lru_cache(1 << 16)
def slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % SLOTS


@lru_cache(1 << 16)
def of_prefix(w: str) -> tuple[int, ...]:
    """Slots that the first five characters settle: of their prefixes, of the label after the word and of that before it."""
    return slot(f"3={w[:3]}"), slot(f"4={w[:4]}"), slot(f"5={w}"), slot(f"<{w}"), slot(f">{w}")


def word_slots(words: Iterable[bytes]) -> list[np.ndarray]:
    """By word: slots of what it says about its own label (six), about the label after it and about the one before it."""
    out: list[int] = []
    for word in words:
        raw = word.decode("utf-8", "replace")
        bare = raw.strip(STRIP)
        w = bare.lower()
        shape = ("U" if raw.isupper() else "T" if raw[:1].isupper() else "l") + ("" if raw.isalpha() else "d" * any(map(str.isdigit, raw)) + "p" * (len(raw) > len(bare)))
        three, four, five, after, before = of_prefix(w[:5])
        out += (xxhash.xxh32_intdigest(f"w={w}") % SLOTS, three, four, five, slot(f"s={w[-3:]}"), slot(f"h={shape}{min(len(w), 12)}"), after, before)
    slots = np.array(out, np.int64).reshape(-1, 8)
    return [slots[:, :6], slots[:, 6:7], slots[:, 7:]]


def features(word: bytes) -> list[list[int]]:
    """The slots of one word."""
    return [s[0].tolist() for s in word_slots([word])]


def said(weights: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """What words say for the toxic label: their own, after them and before them (columns), by the slots of their features."""
    return np.column_stack([weights[s].sum(1) for s in slots])


@dataclass
class Field:
    """weights of features for the toxic label; transition[i, j] and start[j] as logarithms; a, b of the score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    score: tuple[float, float] | None = None  # none: nothing learned

    def probability(self, expected: np.ndarray) -> np.ndarray:
        if self.score is None:
            return np.zeros(len(expected))
        a, b = self.score
        return 1 / (1 + np.exp(-np.clip(a * np.log(expected + 1e-3) + b, -30, 30)))


class Emissions:
    """What each word says for the toxic label (its own, after it, before it), computed once for up to CACHE words."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.place, self.held = weights, {}, np.empty((0, 3))

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row for each of some distinct words."""
        at = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        own = [words[i] for i in new.tolist()]
        values = said(self.weights, word_slots(own))
        out = np.empty((len(words), 3))
        out[new], out[at >= 0] = values, self.held[at[at >= 0]]
        room = max(CACHE - len(self.place), 0)
        self.place.update(zip(own[:room], range(len(self.held), CACHE), strict=False))
        self.held = np.concatenate([self.held, values[:room]])
        return out


def emission(says: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The toxic label's score of each token, of what it and its neighbours in the document say (columns of says)."""
    out = says[:, 0].copy()
    inner = ~begins[1:]
    out[1:] += says[:-1, 1] * inner
    out[:-1] += says[1:, 2] * inner
    return out


def marginals(e: np.ndarray, begins: np.ndarray, transition: np.ndarray, start: np.ndarray, paired: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of the toxic label at each token, and (if paired) of each pair of labels (00, 01, 10, 11) of the token
    before and it; `begins` marks the first token of each document (whose pairs mean nothing).
    """
    n = len(e)
    if not n:
        return np.empty(0), np.empty((4, 0))
    blocks = -(-n // BLOCK)
    x = np.exp(np.clip(e, -30, 30))
    move = np.exp(transition - transition.max())
    first = np.exp(start - start.max())
    size = blocks * BLOCK

    def laid(column: np.ndarray, pad: float) -> np.ndarray:
        out = np.full(size, pad)
        out[:n] = column
        return np.ascontiguousarray(out.reshape(blocks, BLOCK).T)

    at = np.flatnonzero(begins)
    m = [[None, None], [None, None]]  # m[i][j][k]: from label i to j, at the k-th token of every block
    for i in (0, 1):
        for j in (0, 1):
            column = np.full(n, move[i, j])
            column[at] = first[j]
            m[i][j] = laid(column * x if j else column, float(i == j))
    (m00, m01), (m10, m11) = m
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(BLOCK):  # products of whole blocks
        q00, q01 = p00 * m00[k] + p01 * m10[k], p00 * m01[k] + p01 * m11[k]
        q10, q11 = p10 * m00[k] + p11 * m10[k], p10 * m01[k] + p11 * m11[k]
        scale = 1 / (q00 + q01 + q10 + q11)
        p00, p01, p10, p11 = q00 * scale, q01 * scale, q10 * scale, q11 * scale
    product = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True))
    ahead, behind = [], []
    u = v = 0.5
    for c00, c01, c10, c11 in product:
        ahead.append((u, v))
        u, v = u * c00 + v * c10, u * c01 + v * c11
        u, v = u / (u + v), v / (u + v)
    u = v = 0.5
    for c00, c01, c10, c11 in reversed(product):
        behind.append((u, v))
        u, v = c00 * u + c01 * v, c10 * u + c11 * v
        u, v = u / (u + v), v / (u + v)
    u, v = np.array(ahead).T
    forward = np.empty((BLOCK + 1, blocks))  # of label 1, of 1 in all, before each token
    forward[0] = v
    for k in range(BLOCK):
        u, v = u * m00[k] + v * m10[k], u * m01[k] + v * m11[k]
        v = v / (u + v)
        u = 1 - v
        forward[k + 1] = v
    u, v = np.array(behind[::-1]).T
    out, pairs = np.empty((BLOCK, blocks)), np.empty((4, BLOCK, blocks) if paired else (4, 0, 0))
    for k in range(BLOCK - 1, -1, -1):
        one = forward[k + 1] * v
        total = one + (1 - forward[k + 1]) * u
        out[k] = one / total
        if paired:
            a = forward[k]
            b = 1 - a
            scale = 1 / (u * (b * m00[k] + a * m10[k]) + v * (b * m01[k] + a * m11[k]))
            pairs[0, k], pairs[1, k], pairs[2, k], pairs[3, k] = b * m00[k] * u * scale, b * m01[k] * v * scale, a * m10[k] * u * scale, a * m11[k] * v * scale
        u, v = m00[k] * u + m01[k] * v, m10[k] * u + m11[k] * v
        v = v / (u + v)
        u = 1 - v
    return out.T.reshape(-1)[:n], pairs.transpose(0, 2, 1).reshape(4, -1)[:, :n] if paired else None


class Sample:
    """Documents as numbers of their words. Texts of equal words and equal label count once, whatever else they share."""

    def __init__(self, rows: Iterable[tuple[bytes, bool]]):
        numbers: dict[bytes, int] = {}
        once: dict[tuple[bytes, bool], tuple[np.ndarray, bool]] = {}
        for text, t in rows:
            words = text.split()
            if words:
                own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
                once.setdefault((own.tobytes(), bool(t)), (own, bool(t)))
        self.words = list(numbers)
        self.docs = [own for own, _ in once.values()]
        self.toxic = np.array([t for _, t in once.values()], bool)

    def pieces(self) -> Iterator[np.ndarray]:
        """Numbers of documents, some PIECE tokens at a time."""
        total = np.cumsum([len(d) for d in self.docs])
        piece = (total - 1) // PIECE
        for p in np.unique(piece):
            yield np.flatnonzero(piece == p)

    def chances(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where transitions and starts begin: logarithms of how often the labels of marked words follow each other."""
        pairs, starts = np.ones(4), np.ones(2)
        for d, t in zip(self.docs, self.toxic, strict=True):
            y = (marked[d] & t).astype(np.int64)
            pairs += np.bincount(2 * y[:-1] + y[1:], minlength=4)
            starts[y[0]] += 1
        pairs = pairs.reshape(2, 2)
        return np.log(pairs / pairs.sum(1, keepdims=True)), np.log(starts / starts.sum())

    def labelled(self) -> np.ndarray:
        """Which words make a token of a toxic document toxic.

        Telling forms are those of at least a fiftieth of the toxic documents and far rarer in others; then, while toxic
        documents have none, the form that most of these share.
        """
        own_forms = [forms(w) for w in self.words]
        held = lambda d: {f for i in np.unique(d).tolist() for f in own_forms[i]}
        bad, good = Counter(), Counter()
        for d, t in zip(self.docs, self.toxic, strict=True):
            (bad if t else good).update(held(d))
        n_bad, n_good = max(int(self.toxic.sum()), 1), max(int((~self.toxic).sum()), 1)
        rare = lambda f, n: n / n_bad >= ODDS * (good[f] + 0.5) / n_good
        telling = {f for f, n in bad.items() if n >= max(LEAST, n_bad // 50) and rare(f, n)}
        bare = [h for d, t in zip(self.docs, self.toxic, strict=True) if t and not (h := held(d)) & telling]
        while bare:
            form, n = max(Counter(f for own in bare for f in own if rare(f, bad[f])).items(), key=lambda x: (x[1], -len(x[0]), x[0]), default=("", 0))
            if n < 3:
                break
            telling.add(form)
            bare = [own for own in bare if form not in own]
        return np.array([any(f in telling for f in own) for own in own_forms], bool)


def counts(tokens: np.ndarray, size: np.ndarray, toxic: np.ndarray, says: np.ndarray, model: Field, marked: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents one after another: log-likelihood (of documents' labels; 0 with marked tokens), and expected less
    observed counts of the toxic label by token, of pairs and of starts; then the beginnings and the marginals.
    """
    starts = np.cumsum(size) - size
    begins = np.zeros(len(tokens), bool)
    begins[starts] = True
    p, pairs = marginals(emission(says[tokens], begins), begins, model.transition, model.start)
    pairs[:, begins] = 0
    doc = np.repeat(np.arange(len(size)), size)
    likelihood = 0.0
    if marked is not None:
        y = marked[tokens] & toxic[doc]
        seen = np.zeros(4)
        code = 2 * y[:-1] + y[1:]
        seen += np.bincount(code[~begins[1:]], minlength=4)
        by_token, by_pair, by_start = p - y, pairs.sum(1) - seen, p[starts] - y[starts]
    else:
        # P(no toxic token) of each document, as a product of the chances of going on clean.
        clean = np.where(begins, 1 - p, pairs[0] / np.maximum(1 - np.append(0.0, p[:-1]), 1e-300))
        none = np.exp(np.add.reduceat(np.log(np.maximum(clean, 1e-300)), starts))
        some = np.maximum(1 - none, 1e-9)
        likelihood = float(np.log(np.where(toxic, some, np.maximum(none, 1e-300))).sum())
        # Expected counts given the label: of a clean document those of no toxic token, else all less those, rescaled.
        up = np.where(toxic, 1 / some, 0.0)
        by_token = p - p * up[doc]
        inner = (size - 1).astype(float)
        own = np.stack([np.add.reduceat(x, starts) for x in pairs])
        given = own * up
        given[0] += np.where(toxic, -none * inner * up, inner)
        by_pair, by_start = (own - given).sum(1), p[starts] * (1 - up)
    return likelihood, by_token, by_pair, np.array([-by_start.sum(), by_start.sum()]), begins, p


def gradient(sample: Sample, slots: list[np.ndarray], model: Field, marked: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, gradients of weights, transitions and starts, and the expected toxic tokens of each document."""
    says = said(model.weights, slots)
    by_word, pair, start, total, held = np.zeros((len(sample.words), 3)), np.zeros(4), np.zeros(2), 0.0, []
    for own in sample.pieces():
        tokens = np.concatenate([sample.docs[i] for i in own])
        size = np.array([len(sample.docs[i]) for i in own])
        likelihood, g, by_pair, by_start, begins, p = counts(tokens, size, sample.toxic[own], says, model, marked)
        inner = ~begins[1:]
        by_word[:, 0] += np.bincount(tokens, g, len(sample.words))
        by_word[:, 1] += np.bincount(tokens[:-1], g[1:] * inner, len(sample.words))
        by_word[:, 2] += np.bincount(tokens[1:], g[:-1] * inner, len(sample.words))
        pair, start, total = pair + by_pair, start + by_start, total + likelihood
        held.append(np.add.reduceat(p, np.cumsum(size) - size))
    weights = sum(np.bincount(s.ravel(), np.repeat(by_word[:, k], s.shape[1]), SLOTS) for k, s in enumerate(slots))
    return total, weights, pair.reshape(2, 2), start, np.concatenate(held)


def fit(rows: Iterable[tuple[bytes, bool]], rounds: tuple[int, int] = ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adagrad on all rows (text, whether it is toxic)."""
    sample, model = Sample(rows), Field()
    if not sample.toxic.any() or sample.toxic.all():
        return model
    slots = word_slots(sample.words)
    marked = sample.labelled()
    model.transition, model.start = sample.chances(marked)
    squares = [np.full(x.shape, SLOW) for x in (model.weights, model.transition, model.start)]
    for k in range(sum(rounds)):
        _, *g, _ = gradient(sample, slots, model, marked if k < rounds[0] else None)
        g[0] += decay * model.weights
        for own, x, g2 in zip((model.weights, model.transition, model.start), g, squares, strict=True):
            g2 += x * x
            own -= rate * x / np.sqrt(g2)
    held = gradient(sample, slots, model, None)[-1]
    model.score = logistic(np.log(held + 1e-3), sample.toxic)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a x + b))) by Newton steps with a little shrinkage of a."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        w = w - np.linalg.solve(h, design.T @ (p - y) + ridge * w)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, toxic: int = TOXIC, clean: int = CLEAN, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Field:
    """Fit on at most `toxic` + `clean` documents whose fold isn't 0, on whole texts."""
    known = labels.select(named(doc_id).alias("id"), named(label).cast("int").alias("y")).where("id is not null and y is not null").where(crc_mod("id", folds) != 0)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    picked = [known.where("y > 0").orderBy(F.xxhash64("id"), "id").limit(toxic), known.where("y <= 0").orderBy(F.xxhash64("id"), "id").limit(clean)]
    ids = picked[0].unionByName(picked[1])  # at most toxic + clean rows: may be broadcast
    rows = docs.select(named(doc_id).alias("id"), named(text).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id")
    model = fit(((r["text"] or "").encode(), r["y"] > 0) for r in rows.toLocalIterator())
    tidy()
    return model


def expected(texts: list[bytes], model: Field, emissions: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, the marginal of each word, and the expected number of toxic tokens of each text."""
    words = Words(texts)
    every, number = words.distinct()
    says = emissions.of(every)[number]
    starts = (np.cumsum(words.n) - words.n)[words.n > 0]
    begins = np.zeros(len(says), bool)
    begins[starts] = True
    p = marginals(emission(says, begins), begins, model.transition, model.start, paired=False)[0] if len(says) else np.empty(0)
    total = np.zeros(len(texts))
    if len(starts):
        total[words.n > 0] = np.add.reduceat(p, starts)
    return words.n, p, total


def score_documents(docs: DataFrame, model: Field, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_tokens (expected), spans (character offsets of toxic stretches)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model.weights)
        for part in chunks(batches, "text", 4 << 20):
            n, p, total = expected(text_bytes(part.column("text")), model, emissions)
            score = model.probability(total)
            hits = np.split(p >= 0.5, np.cumsum(n)[:-1]) if len(n) else []
            texts = part.column("text")
            found = [stretches(texts[i].as_py(), hit) if hit.any() else [] for i, hit in enumerate(hits)]
            columns = [part.column("id").combine_chunks(), part.column("held_out").combine_chunks(), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(total), pa.array(found, span)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "score", "predicted", "toxic_tokens", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(named(doc_id).alias("id"), (crc_mod(doc_id, folds) == 0).alias("held_out"), named(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, toxic_tokens double, spans array<struct<start:int,end:int>>").withColumnRenamed("id", doc_id)


def stretches(text: str, hit: np.ndarray) -> list[dict]:
    """Character offsets of the runs of marked words."""
    out: list[dict] = []
    before = False
    for mark, word in zip(hit.tolist(), re.finditer(r"[^\x20\x09-\x0D]+", text), strict=True):
        if mark and before:
            out[-1]["end"] = word.end()
        elif mark:
            out.append({"start": word.start(), "end": word.end()})
        before = mark
    return out


def drop_toxic(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""

    def start():
        emissions = Emissions(model.weights)
        return lambda texts: model.probability(expected(texts, model, emissions)[2]) < 0.5

    return filter_rows(docs, text, start)
