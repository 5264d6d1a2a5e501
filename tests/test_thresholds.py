"""Thresholds that follow their outcomes: a stream in several loads against a plain loop over the events of each name."""

import numpy as np

from drawlens.streaming import thresholds


def loop(events, first, pace):
    x, v, won = first, 0.0, []
    for success, error in events:
        push = -pace.rate * 0.1 if success else pace.rate * (min(error, 0.5) if error else 0.2)
        v = pace.momentum * v + push
        x = max(first / pace.span, min(x + v, first * pace.span))
        won.append(success)
    recent = won[-pace.kept :]
    share = sum(recent) / len(recent)
    return x, v, len(won), won.count(False), share, len(won) >= pace.trial and share < pace.least


def test_loads_equal_a_loop(spark, tmp_path):
    r = np.random.default_rng(3)
    initial, odds = {1: 0.2, 2: 0.9, 3: 0.05, 5: 1.0}, {1: 0.5, 2: 0.02, 3: 1.0}
    pace, path = thresholds.Pace(rate=0.05), str(tmp_path)
    seen = {k: [] for k in odds}
    for load in range(3):
        rows = []
        for place in r.permutation(90).tolist():
            for name, odd in odds.items():
                error = [None, 0.0, float(r.random())][int(r.integers(0, 3))]
                rows.append((name, 90 * load + place, bool(r.random() < odd), error))
        own = [(9, 1, True, 0.1), (1, 2, None, 0.1), (None, 3, False, 0.1)]
        spark.createDataFrame(rows + own, thresholds.OUTCOME).repartition(3).write.mode("append").parquet(f"{path}/in")
        for name, _, success, error in sorted(rows, key=lambda x: x[1]):
            seen[name].append((success, error))
        for _ in range(2):  # nothing new the second time
            thresholds.take(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", initial, pace)
        got = {x["name"]: x for x in thresholds.current(spark, f"{path}/out").collect()}
        assert set(got) == set(odds)
        for name, events in seen.items():
            x, v, attempts, failures, share, relax = loop(events, initial[name], pace)
            row = got[name]
            assert np.allclose((row["threshold"], row["velocity"], row["success_rate"]), (x, v, share), atol=1e-9)
            assert (row["attempts"], row["failures"], row["relax"]) == (attempts, failures, relax)
    assert got[2]["relax"] and got[2]["threshold"] == 9.0 and not got[3]["relax"]
