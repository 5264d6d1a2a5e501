"""Operators that count over the corpus, against brute force, in one step and in two."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from drawlens.llm import batches, bpe, lm, substring
from drawlens.llm.common import word_hashes

FANS = [batches.FAN, 1]  # with 1, requests travel in two steps


def words(t):
    return (t or "").encode().split()


def test_keys_and_arrays_survive_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        keys = np.sort(r.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(batches.unpack_keys(batches.pack_keys(keys)), keys)
    few = np.array([0, 0, 1, 2**40 - 1, 2**40, 2**64 - 1], np.uint64)
    assert np.array_equal(batches.unpack_keys(batches.pack_keys(few)), few)
    blobs = np.array([b"", b"abc", b"\0", b""], object)[:-1]
    got = batches.unpack_arrays(batches.pack_arrays([few, blobs, np.empty(0, "<u4")]), ["<u8", "O", "<u4"])
    assert np.array_equal(got[0], few) and got[1].tolist() == blobs.tolist() and len(got[2]) == 0


def test_word_hashes_tell_words_apart():
    r = random.Random(0)
    parts = [b" ", b"\t", b"a", b"b", b"\x1c", b"\x00", "é".encode(), b"\n", b"Z"]
    texts = [b"".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += [b"x" * 1000 + b" y", b"", b" ", *(b"a" * n for n in (8, 9, 16, 17, 256, 257)), b"a\0", b"a"]
    for lower in (False, True):
        h, n = word_hashes(texts, lower)
        own = [(x.lower() if lower else x).split() for x in texts]
        assert [len(w) for w in own] == n.tolist()
        seen = {}
        assert all(seen.setdefault(w, x) == x for w, x in zip([w for o in own for w in o], h.tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("fan", FANS)
def test_substring_equals_brute_force(docs, texts, fan):
    seen = Counter(tuple(w[i : i + 35]) for w in map(words, texts) for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in substring.kept_digest(docs, fan=fan).collect()}
    whole = {r["doc_id"]: r for r in substring.remove_repeats(docs, carry=("lang", "batch", "n_words", "repeats"), fan=fan).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        own = whole[i]["_repeats"]
        assert own["kept_text"] == (kept.decode() if any(gone) else t) and sum(s["end"] - s["start"] for s in own["removed"]) == sum(gone) == own["n_removed"]
        assert (whole[i]["batch"], whole[i]["n_words"], whole[i]["repeats"]) == (1, "y", 3)


def test_without_repeats_keeps_columns_of_any_name(spark, docs):
    out = substring.without_repeats(docs.withColumnRenamed("source", "kept_text").withColumnRenamed("lang", "a.b").withColumnRenamed("id", "removed"))
    assert out.columns == ["doc_id", "text", "a.b", "kept_text", "n_chars", "batch", "removed", "node", "n_words", "repeats", "key"] and out.count() == docs.count()


def test_windows_differ_by_either_hash():
    keys, check = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 1, 1, 1], np.uint32)
    inverse, first = substring.distinct(keys, check)
    assert inverse.tolist() == [0, 1, 2, 0, 2] and keys[first].tolist() == [5, 5, 7]


def plain_lm(texts, order, folds=10):
    """Deleted interpolation in plain Python: dictionaries of counts, EM over binned probabilities."""
    tokens = [[*((t or "").encode().lower().split()), None] for t in texts]
    roles = [lm.TEST if lm.fold(i, folds) == 0 else lm.DELETED if lm.fold(i, folds * 10) // folds == 0 else lm.TRAIN for i in range(len(tokens))]

    def count(held):
        grams, contexts = Counter(), Counter()
        for w, role in zip(tokens, roles, strict=True):
            if role in held:
                for k in range(len(w)):
                    for n in range(1, order + 1):
                        context = tuple(["<"] * max(0, n - 1 - k) + w[max(0, k - n + 1) : k])[-(n - 1) :] if n > 1 else ()
                        context = ("<", *[x for x in context if x != "<"]) if "<" in context else context
                        grams[n, context, w[k]] += 1
                        contexts[n, context] += 1
        return grams, contexts

    def parts(counts, w, k):
        grams, contexts = counts
        out, level, power = [], 0, 0
        for n in range(1, order + 1):
            context = tuple(w[max(0, k - n + 1) : k])
            context = ("<", *context) if len(context) < n - 1 else context
            total = contexts[n, context if n > 1 else ()]
            if not total:
                break
            level, power = n, int(math.log2(total)) if n > 1 else 0
            out.append(grams[n, context if n > 1 else (), w[k]] / total)
        return (level, power), out

    whole, kept = count((lm.TRAIN, lm.DELETED)), count((lm.TRAIN,))
    known = len({g[2] for g in whole[0] if g[0] == 1})
    uniform, rows = 1 / (known + 1), Counter()
    for w, role in zip(tokens, roles, strict=True):
        if role == lm.DELETED:
            for k in range(len(w)):
                bucket, p = parts(kept, w, k)
                rows[bucket, tuple(2.0 ** (round(math.log2(x) * lm.OCTAVE) / lm.OCTAVE) if x else 0.0 for x in p)] += 1

    def em(some, level):
        w = [1 / (level + 1)] * (level + 1)
        for _ in range(lm.ROUNDS if some else 0):
            new = [0.0] * (level + 1)
            for p, n in some:
                share = [a * b for a, b in zip(w, [uniform, *p], strict=True)]
                new = [x + n * s / sum(share) for x, s in zip(new, share, strict=True)]
            w = [x / sum(n for _, n in some) for x in new]
        w[0] = max(w[0], 1e-6) if some else w[0]
        return [x / sum(w) for x in w]

    weights, scores, sums = {}, [], []
    for w in tokens:
        score = 0.0
        for k in range(len(w)):
            bucket, p = parts(whole, w, k)
            if bucket not in weights:
                own = [(q, n) for (b, q), n in rows.items() if b == bucket] or [(q, n) for (b, q), n in rows.items() if b[0] == bucket[0]]
                weights[bucket] = em(own, bucket[0])
            score += math.log10(sum(a * b for a, b in zip(weights[bucket], [uniform, *p], strict=True)))
        scores.append(score)
    vocabulary = [*{g[2] for g in whole[0] if g[0] == 1}, "never seen"]
    for w in tokens[:12]:  # what follows a context, over all words and one unknown
        for k in (0, len(w) // 2, len(w) - 1):
            total = 0.0
            for x in vocabulary:
                bucket, p = parts(whole, [*w[:k], x], k)
                mix = weights.get(bucket) or em([(q, n) for (b, q), n in rows.items() if b[0] == bucket[0]], bucket[0])
                total += sum(a * b for a, b in zip(mix, [uniform, *p], strict=True))
            sums.append(total)
    return scores, sums


@pytest.mark.parametrize("order, fan", [(3, batches.FAN), (2, batches.FAN), (3, 1)])
def test_lm_equals_brute_force(docs, texts, order, fan):
    tokens = [[*((t or "").encode().lower().split()), None] for t in texts]
    train = Counter(x for i, w in enumerate(tokens) if lm.fold(i, 10) for x in w)
    n, v = sum(train.values()), len(train)
    rows = {r["doc_id"]: r for r in lm.score_documents(docs, order=order, fan=fan).collect()}
    scores, sums = plain_lm(texts, order)
    assert all(math.isclose(x, 1, rel_tol=1e-9) for x in sums)
    for i, w in enumerate(tokens):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (lm.fold(i, 10) == 0, len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], scores[i], rel_tol=1e-9)


def test_lm_without_training_or_deleted_rows(frame):
    test = next(i for i in range(1000) if lm.fold(i, 10) == 0)
    (row,) = lm.score_documents(frame(["a b"], test)).collect()
    assert (row["train_tokens"], row["n_known"], row["score"]) == (0, 0, 0.0)
    train = next(i for i in range(1000) if lm.fold(i, 10) and lm.fold(i, 100) // 10)
    (row,) = lm.score_documents(frame(["a b"], train)).collect()
    # Even mixtures of what takes part: uniform 1/4, unigram 1/3, then certain bigrams and trigrams.
    assert math.isclose(row["score"], 3 * math.log10((1 / 4 + 1 / 3 + 1 + 1) / 4))


def test_em_finds_the_better_order():
    p = np.array([[1e-4, 1e-3, 0.5]])
    assert lm.em(p, np.array([100.0]))[2] > 0.99


def library():
    tiktoken = pytest.importorskip("tiktoken")
    from drawlens.llm.queries import tokenizer

    path, pattern = tokenizer()
    vocabulary = bpe.Vocabulary(bpe.load_ranks(path))
    return path, pattern, vocabulary, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.mark.parametrize("fan", FANS)
def test_bpe_equals_library(docs, texts, fan):
    path, pattern, _, reference = library()
    rows = {r["doc_id"]: r for r in bpe.tokenize(docs, path, pattern, keep_ids=True, fan=fan).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_odd_texts():
    _, pattern, vocabulary, reference = library()
    r = random.Random(1)
    odd = ["", "a" * 3000, "ab" * 999, "!!!??" * 50, " " * 77, "日本語🙂🙂 ñandú", "<|endoftext|>", "\x1c\x1d \x85 　", "=-" * 500, "aaab" * 300]
    odd += ["".join(r.choice("ab cdé\n1!'st") for _ in range(200)) for _ in range(100)]
    odd += ["".join(r.choice(["in", "ing", "the", "er", "a", "s", "th", "e"]) for _ in range(200)) for _ in range(100)]
    ids, n = bpe.encode_texts(odd, vocabulary, bpe.compiled(pattern))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [reference.encode_ordinary(x) for x in odd]


def test_bpe_time_of_long_pieces_is_linear():
    import time

    _, _, vocabulary, _ = library()
    began = time.perf_counter()
    ids, _ = vocabulary.encode_words([b"a" * 400_000])
    assert time.perf_counter() - began < 5 and vocabulary.decode(ids) == b"a" * 400_000


def test_bpe_empty_and_repeated(docs):
    path, pattern, _, _ = library()
    assert bpe.tokenize(docs.where("doc_id < 0"), path, pattern).count() == 0
    twice = bpe.tokenize(docs.where("doc_id = 3").union(docs.where("doc_id = 3")), path, pattern).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("run", [substring.kept_digest, substring.remove_repeats, substring.without_repeats, lm.score_documents])
def test_empty_tables(docs, run):
    assert run(docs.where("doc_id < 0")).count() == 0


def test_table_of_pieces_holds_every_piece_once():
    _, pattern, vocabulary, _ = library()
    part, second = bpe.pieces(pa.table({"doc": [1, 2], "text": ["zqxj zqxj", None]}), "text", bpe.compiled(pattern), vocabulary.ranks)
    rows, flat, known, level = bpe.unstaged(part)
    assert rows.tolist() == [2, 0] and len(known) == 2 and len(bpe.others(second)) == len(level) == int((known < 0).sum())
