"""Feature frames against loops and numpy, and itemsets by bitmaps against listing."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.operators import frames, pairs


@pytest.fixture(scope="module")
def history():
    r = random.Random(11)
    return [(500 + 3 * i + (i > 30), sorted(r.sample(range(1, 81), 20))) for i in range(75)]


@pytest.fixture(scope="module")
def numbers(spark, history):
    return spark.createDataFrame([(issue, n) for issue, own in history for n in own], "issue bigint, num int").cache()


def expected(history, width, window):
    for i in range(width, len(history)):
        near = [own for _, own in reversed(history[i - width : i])]
        features = [len(set(a) & set(b)) for a, b in zip(near, near[1:], strict=False)]
        counts = Counter(n for own in near for n in own)
        features += [counts[n] for n in range(1, 81)] + [sum(n % 2 for n in own) for own in near]
        features += [sum((n - 1) // 10 == g for n in own) for own in near for g in range(8)]
        past = Counter(n for _, own in history[max(0, i - window) : i] for n in own)
        hot = sorted(range(1, 81), key=lambda n: (-past[n], n))[:10]
        yield history[i][0], features, len(set(hot) & set(history[i][1]))


@pytest.mark.parametrize(("width", "window", "block"), [(10, 50, 4096), (10, 50, 7), (3, 5, 64), (1, 50, 10), (10, 4, 3)])
def test_frames_equal_a_loop(numbers, history, width, window, block):
    got = {r["issue"]: (r["features"], r["target"]) for r in frames.frames(numbers, width, window, block=block).collect()}
    assert got == {i: (f, t) for i, f, t in expected(history, width, window)}
    assert width != 10 or {len(f) for f, _ in got.values()} == {179}


def test_frames_of_short_histories(numbers):
    assert frames.frames(numbers.where("issue < 530")).collect() == []
    assert frames.frames(numbers.where("issue < 0")).collect() == []


def test_frames_have_no_window_over_everything(numbers, capsys):
    frames.frames(numbers).explain("formatted")
    windows = [x for x in capsys.readouterr().out.split("\n\n") if "Window" in x.split("\n")[0] and "Arguments" in x]
    assert windows and all("_block" in x or "_range" in x for x in windows)


def test_components_and_forecast_equal_numpy(numbers, history):
    framed = frames.frames(numbers)
    rows = sorted(expected(history, 10, 50))
    x = np.array([f for _, f, _ in rows], float)
    sd = x.std(0, ddof=1)
    z = np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    out, share = frames.components(framed, 5)
    assert np.allclose(share, (values / values.sum())[:5])
    got = np.array([r["components"].toArray() for r in out.orderBy("issue").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vectors[:, :5]), atol=1e-6)
    told = frames.forecast(framed, 5).orderBy("issue").collect()
    cut = round(len(rows) * 0.8)
    assert [(r["issue"], r["target"]) for r in told] == [(i, t) for i, _, t in rows[cut:]]
    a, y = (z @ vectors[:, :5])[:cut], np.array([t for *_, t in rows[:cut]], float)
    m, s, sy = a.mean(0), a.std(0, ddof=1), y.std(ddof=1)
    n = (a - m) / s
    w = np.linalg.solve(n.T @ n / cut + 0.01 / sy * np.eye(5), n.T @ (y - y.mean()) / cut) / s
    assert np.allclose([r["prediction"] for r in told], ((z @ vectors[:, :5])[cut:] - m) @ w + y.mean(), atol=0.05)


def listed(history, most, support):
    counts = Counter(c for _, own in history for k in range(1, most + 1) for c in combinations(own, k))
    return {c: n for c, n in counts.items() if n / len(history) >= support}


@pytest.mark.parametrize(("most", "support"), [(1, 0.0), (2, 0.0), (3, 0.05), (4, 0.06), (5, 0.06)])
def test_itemsets_equal_listing(numbers, history, most, support):
    h = numbers.withColumn("rn", (F.col("issue") * 7 % 1009).cast("int"))
    got = {tuple(r["items"]): r["freq"] for r in pairs.itemsets(h, most, support).collect()}
    assert got == listed(history, most, support)


def test_rules_of_three(numbers, history):
    h = numbers.withColumn("rn", F.col("issue"))
    sets, n = listed(history, 3, 0.05), len(history)
    expected_ = {}
    for items, c in sets.items():
        for x in items if len(items) > 1 else ():
            rest = tuple(y for y in items if y != x)
            if c / sets[rest] >= 0.3:
                expected_[rest, x] = (round(c / n, 6), round(c / sets[rest], 6), round(c / sets[rest] / (sets[x,] / n), 6))
    got = {(tuple(sorted(r["antecedent"])), r["consequent"]): (r["support"], r["confidence"], r["lift"]) for r in pairs.association_rules(h, 0.05, 0.3, 3).collect()}
    assert got.keys() == expected_.keys() and all(np.allclose(got[k], expected_[k]) for k in got)
