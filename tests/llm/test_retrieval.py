"""Decontamination against scoring every passage and item, and nearest neighbours against exact search."""

import math
import random
from collections import Counter

import numpy as np

from drawlens.llm import ann, decontam


def test_wand_equals_scoring_all():
    r = random.Random(5)
    words_ = [f"w{i}" for i in range(60)]
    items = [(i, t.split(), t) for i, t in ((i, " ".join(r.choice(words_) for _ in range(r.randrange(2, 25)))) for i in range(90))]
    df = Counter(t for _, w, _ in items for t in set(w))
    index = decontam.Index(items, 32, df, len(items), 12.0)
    for _ in range(200):
        query = sorted(r.sample(range(len(index.docs)), r.randrange(1, 40)))
        score: Counter = Counter()
        for t in query:
            for i, x in zip(index.docs[t], index.impacts[t], strict=True):
                score[i] += x
        assert {i for i, _ in index.wand(query)} == {i for i, x in score.items() if x >= 1}


def plain_leaks(docs, items):
    """Every passage against every item: BM25, then word pairs."""
    texts = {i: decontam.terms((t or "").encode()) for i, t in items.items()}
    texts = {i: w for i, w in texts.items() if w}
    df, mean = Counter(t for w in texts.values() for t in set(w)), sum(map(len, texts.values())) / max(len(texts), 1)
    found = set()
    for doc, text in docs.items():
        words = [decontam.normal(w) for w in (text or "").encode().split()]
        for item, own in texts.items():
            impact = {}
            for t, tf in Counter(own).items():
                idf = math.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5))
                impact[t] = idf * tf * (decontam.K1 + 1) / (tf + decontam.K1 * (1 - decontam.B + decontam.B * len(own) / mean))
            span = decontam.length_class(len(own))
            for first in range(0, max(len(words) - span, 1), span):
                passage = words[first : first + 2 * span]
                if sum(x for t, x in impact.items() if t in set(passage)) >= decontam.SHARE * sum(impact.values()) - 1e-9:
                    held = decontam.pairs_of(passage)
                    parts = [decontam.pairs(decontam.terms(p.encode())) for p in decontam.split_item(items[item])]
                    if all(len(p & held) / len(p) >= decontam.OVERLAP for p in parts):
                        found.add((doc, item))
    return found


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = {i: prose(r.randrange(4, 60)) + ". " + prose(r.randrange(3, 12)) for i in range(25)} | {100: None, 101: "", 102: "...", 103: prose(400)}
    docs = {i: prose(r.randrange(0, 300)) for i in range(60)} | {900: None, 901: "", 902: items[103] + " " + prose(2000)}
    for i in range(40):
        own = items[r.randrange(25)].split()
        for k in r.sample(range(len(own)), r.randrange(0, max(len(own) // 5, 1))):
            own[k] = "other"
        docs[200 + i] = f"{prose(r.randrange(200))} {' '.join(own).upper()}! {prose(r.randrange(200))}"
    return docs, items


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1, "q") for x in docs.items()], "doc_id bigint, text string, item_id int, id string").repartition(3)
    b = spark.createDataFrame([(*x, 2) for x in items.items()], "item_id bigint, text string, doc_id int")
    expected = plain_leaks(docs, items)
    assert len(expected) > 20 and (902, 103) in expected
    for size, matrix in ((decontam.SHARD_CHARS, decontam.MATRIX), (2500, 60)):
        monkeypatch.setattr(decontam, "MATRIX", matrix)
        got = decontam.find_leaks(d, b, shard_chars=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
        kept = decontam.drop_leaks(d, b, shard_chars=size)
        assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(docs) - {x for x, _ in expected}


def test_an_unrelated_long_item_changes_no_passage(spark):
    r = random.Random(3)
    words = [f"v{i}" for i in range(40)]
    item = "one two three four five six seven. eight nine ten eleven"
    scattered = " ".join(w + " " + " ".join(r.choice(words) for _ in range(40)) for w in item.split())
    d = spark.createDataFrame([(1, scattered), (2, "x " * 50 + item)], "doc_id bigint, text string")
    short, long = [(1, item)], [(1, item), (2, " ".join(f"z{i}" for i in range(1000)))]
    for rows in (short, long):
        got = decontam.find_leaks(d, spark.createDataFrame(rows, "item_id bigint, text string")).collect()
        assert [(x["doc_id"], x["item_id"]) for x in got] == [(2, 1)]


def test_leaks_of_empty_and_repeated_rows(spark, docs, texts, frame):
    item = "Which colour has the deep sea at noon. The sea is blue and very cold"
    extra = frame(["before " * 150 + item.upper() + "! after " * 90, "the sea is blue"], 1000)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "unseen words only here . nothing else at all")], "item_id bigint, text string")
    got = decontam.find_leaks(docs.union(extra).union(extra), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1000, 1)] * 2
    none = bench.where("item_id < 0")
    assert decontam.drop_leaks(docs.union(extra), bench).count() == len(texts) + 1
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.drop_leaks(docs, none).count() == len(texts)
    assert decontam.find_leaks(docs.where("doc_id < 0"), bench).count() == 0 and decontam.drop_leaks(docs.where("doc_id < 0"), bench).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id bigint, embedding array<float>, label int, id int, score double")


def test_ann_recall_and_odd_vectors(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[7] = x[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0, None, *[0.0] * 14], 0), (5080, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    got: dict = {}
    for row in ann.nearest(vectors(spark, rows), k=10, every=100).collect():
        got.setdefault(row["query_id"], []).append(row)
    assert sorted(got) == list(range(0, 3000, 100))
    wide, hit = x.astype(float), 0
    for q, own in got.items():
        score = wide @ wide[q]
        score[q] = -np.inf
        own.sort(key=lambda a: a["rank"])
        hit += len({a["vec_id"] for a in own} & set(np.lexsort((np.arange(3000), -score))[:10].tolist()))
        assert [(-a["score"], a["vec_id"]) for a in own] == sorted((-a["score"], a["vec_id"]) for a in own)
        assert all(math.isclose(a["score"], score[a["vec_id"]], rel_tol=1e-9) for a in own)
    assert hit / (10 * len(got)) >= 0.9


def test_ann_windows_widen_outwards():
    r = np.random.default_rng(1)
    x = r.standard_normal((500, 8))
    index = ann.Index(np.arange(500), x)
    at, arrays = x[:3] @ index.axes[:8, :4], np.tile(np.arange(4), (3, 1))
    low, high = zip(*(index.windows(at.astype(np.float32), arrays, level) for level in range(30)), strict=True)
    assert all((b <= a).all() for a, b in zip(low, low[1:], strict=False)) and all((b >= a).all() for a, b in zip(high, high[1:], strict=False))
    assert (low[-1] == 0).all() and (high[-1] == 500).all()


def test_ann_small_tables(spark):
    assert ann.nearest(vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0)]), every=20).count() == 1
    assert ann.nearest(vectors(spark, [])).count() == 0
    twice = ann.nearest(vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)])).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(twice)] == [(1, 1), (2, 1), (3, 2)]
