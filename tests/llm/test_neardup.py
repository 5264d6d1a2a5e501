"""SimHash groups, near duplicates and components against brute force; hot keys in small cells."""

import random

import numpy as np
import pytest
import xxhash

from drawlens.llm import neardup, pairing, simhash
from drawlens.llm.components import connected_components


def brute_print(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("limit", [pairing.LIMIT, 3])
def test_simhash_equals_brute_force(docs, texts, components, limit):
    prints = [brute_print(t) for t in texts]
    expected = components(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    rows = {r["doc_id"]: r for r in simhash.simhash_groups(docs, limit=limit).collect()}
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in range(len(texts))] == expected


@pytest.mark.parametrize("most", [1, 3, 6, 9])
def test_pigeonhole_loses_no_pair(most):
    r = np.random.default_rng(most)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    plan = simhash.plan(base, len(base), most)
    assert sum(t + 1 for _, t in plan) == most + 1
    masks = [m for bits, t in plan for m in simhash.keys_of(bits, t)]
    for x in base[:60].tolist():
        y = x
        for b in r.choice(64, most, replace=False).tolist():
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_forest_links_what_is_near():
    r = np.random.default_rng(0)
    fps = np.array([0b1, 0b11, 0b111, *r.integers(0, 2**63, 5)], np.uint64)
    zero = np.zeros(8, np.int64)
    assert simhash.forest(zero, zero.astype(bool), zero, fps, 1).tolist()[:3] == [0, 0, 0]
    apart = np.array([0, 0, 1, 1, 1, 1, 1, 1])  # of two blocks, only pairs across
    assert simhash.forest(zero, zero == 0, apart, fps, 1).tolist()[:3] == [0, 1, 1]


@pytest.mark.parametrize("limit", [2, 3, 100])
def test_cells_hold_every_pair_of_a_key(spark, limit):
    rows = [(k, n) for k, own in ((1, range(9)), (2, [3, 4]), (3, [5])) for n in own]
    frame = pairing.dealt(pairing.cells(spark.createDataFrame(rows, "key bigint, node bigint"), limit=limit)).toPandas().sort_values(["key", "a", "b", "part", "node"], ignore_index=True)
    own, seen = pairing.numbers(frame), []
    crossed, part = (frame["a"] != frame["b"]).to_numpy(), frame["part"].to_numpy()
    for i, j in pairing.at_lags(own, crossed, part):
        seen += [(k, *sorted(p)) for k, *p in zip(frame["key"][i], frame["node"][i], frame["node"][j], strict=True)]
    assert sorted(seen) == [(1, a, b) for a in range(9) for b in range(a + 1, 9)] + [(2, 3, 4)]


def test_spans():
    start, end = np.array([1, 2, 3, 3, 9]), np.array([4, 2, 5, 4, 8])
    expected = [(i, j) for i in range(5) for j in range(start[i], end[i])]
    for most in (1, 2, 3, 100):
        assert [p for i, j in pairing.spans(start, end, most) for p in zip(i.tolist(), j.tolist(), strict=True)] == expected
    assert list(pairing.spans(start[:0], end[:0])) == []


@pytest.mark.parametrize("limit", [pairing.LIMIT, 3])
def test_near_duplicates(spark, docs, texts, components, limit):
    sets = [shingles(t) for t in texts]
    expected = components(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    rows = {r["id"]: r["component"] for r in neardup.near_duplicates(docs, limit=limit).collect()}
    assert [rows[i] for i in range(len(texts))] == expected
    again = docs.union(docs.where("doc_id < 10"))
    kept = neardup.keep_one(again, limit=limit)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))
    assert neardup.keep_one(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("nearest, most", [(1, 9), (4, 9), (4, 0)])
def test_near_duplicates_of_a_crowded_key(spark, frame, components, nearest, most):
    """Many near copies: however few are proposed, groups are those of all pairs."""
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    own = []
    for _ in range(70):
        w = list(base)
        for k in r.sample(range(120), r.randrange(2, 9)):
            w[k] = f"x{r.randrange(10**6)}"
        own.append(" ".join(w))
    sets = [shingles(t) for t in own]
    expected = components(len(own), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)  # keys longer than a batch
    got = {x["id"]: x["component"] for x in neardup.near_duplicates(frame(own), nearest=nearest, most=most, limit=20).collect()}
    spark.conf.set(batch, before)
    assert [got[i] for i in range(len(own))] == expected


def test_near_duplicates_beyond_the_bits(frame, components):
    """Similar texts whose fingerprints are far apart: appended, replaced as a block, short, one line repeated."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**6)}"
    own = []
    for _ in range(60):
        base = [word() for _ in range(120)]
        own += [base, base + [word() for _ in range(28)]]
        short = [word() for _ in range(8)]
        own += [short, [*short, word()]]
        long = [word() for _ in range(404)]
        own += [long, long[:180] + [word() for _ in range(40)] + long[220:]]
    line = [word() for _ in range(10)]
    base = [word() for _ in range(120)]
    own += [base + line, base + line * 40]
    own = [" ".join(x) for x in own]
    sets = [shingles(t) for t in own]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    prints = [simhash.fingerprint(x) for x in neardup.shingle_sets([t.encode() for t in own], 5)]
    assert sum(similar(i, i + 1) and ((prints[i] ^ prints[i + 1]) & (2**64 - 1)).bit_count() > neardup.MOST for i in range(0, len(own), 2)) > 5
    got = {x["id"]: x["component"] for x in neardup.near_duplicates(frame(own)).collect()}
    assert [got[i] for i in range(len(own))] == components(len(own), similar)


def test_parity_bits_exclude_no_similar_pair():
    r = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 40, 90, 700, 30_000):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[: max(1, int(0.85 * n))]), np.unique(np.concatenate([base, r.integers(0, 2**63, n // 5, dtype=np.uint64)]))]
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    good = neardup.possible(i, j, np.array([len(s) for s in sets]), [neardup.parity(s) for s in sets], 0.8)
    similar = np.array([len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert good[similar].all() and good.sum() < 2 * similar.sum()


@pytest.mark.parametrize("limit", [pairing.LIMIT, 3])
def test_a_pair_is_named_once_however_many_keys_it_shares(spark, frame, limit):
    r = random.Random(5)
    texts = []
    for g in range(3):
        base = [f"w{g}x{i}" for i in range(200)]
        for k in range(6):
            own = list(base)
            for at in r.sample(range(200), 1 + k % 3):
                own[at] = f"new{g}x{k}x{at}"
            texts.append(" ".join(own))
    rows = frame(texts).selectExpr("doc_id AS id", "doc_id AS node", "text")
    nodes = neardup.sketches(rows, 5, 0.8).selectExpr("node", "node AS `group`", "size", "marks", "prefix")
    shared = pairing.cells(neardup.prefix_keys(nodes), "group", limit)
    named = [tuple(x) for x in neardup.meetings(shared, nodes, 0.8).collect()]
    own = [shingles(t) for t in texts]
    similar = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])}
    assert len(similar) > 30 and similar <= set(named)
    assert len(named) < 1.2 * len(set(named))


def test_pairs_whose_heads_share_nothing_are_named_at_every_key():
    x, y = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 3]]), np.array([[3, 2, 9], [3, 2, 9], [7, 8, 9]])
    assert neardup.own_key(np.array([2, 3, 5]), x, y).tolist() == [True, False, True]


def test_keep_one_keeps_each_text_of_a_repeated_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = spark.createDataFrame([(5, a), (5, b), (9, b), (5, a), (None, a), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(rows).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (None, a), (None, None)], key=str)


def test_simhash_of_null_ids_and_empty_tables(spark, docs):
    rows = spark.createDataFrame([(None, "a b"), (4, "a b"), (2, "A b")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(rows).collect()} == {(None, None), (4, 2), (2, 2)}
    assert simhash.simhash_groups(docs.where("doc_id < 0")).count() == 0 and neardup.near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_components(spark, components):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)] + [(600, i) for i in range(601, 640)]
    linked = {(max(e), min(e)) for e in edges}
    expected = components(640, lambda a, b: (a, b) in linked)
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {x["node"]: x["component"] for x in connected_components(frame).collect()}
    assert got == {x: expected[x] for e in edges if e[0] != e[1] for x in e}
    with pytest.raises(RuntimeError):
        connected_components(frame, rounds=1)
