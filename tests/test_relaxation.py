"""Relaxation stage by stage: batches equal a plain loop that looks at one proposal after another."""

import random

import pytest
from pyspark.sql import functions as F

from drawlens.operators import candidates, constraints, generation
from drawlens.sources.draws import recent


@pytest.fixture(scope="module")
def profile(spark):
    r = random.Random(2)
    rows = [(i, n) for i in range(100) for n in r.sample(range(1, 81), 20)]
    return constraints.profile(recent(spark.createDataFrame(rows, "issue bigint, num int"), 100), 50, 6)


def plain(spark, p, total, start, patience, seed=42):
    """The loop: after every change of a threshold all proposals are validated anew under the new ones."""
    thresholds, found, at, relaxations = list(start), [], 0, 0
    proposals = [tuple(r["nums"]) for r in candidates.heuristic_tickets(spark, p, 600, seed=seed).orderBy("ticket_id").collect()]

    def codes():
        # One ticket an id and set, so that the check for duplicates stays out of it.
        df = spark.createDataFrame([(i, list(x)) for i, x in enumerate(dict.fromkeys(proposals))], "ticket_id bigint, nums array<int>")
        return {tuple(r["nums"]): r["code"] for r in constraints.validate(df, p, tuple(thresholds)).collect()}

    code = codes()
    while len(found) < total:
        failures, deepest, tries = [0] * 6, -1, 0
        while True:
            nums = proposals[at]
            at += 1
            if nums in (x for x, *_ in found):
                continue
            tries += 1
            c = code[nums]
            if c == 99:
                found.append((nums, list(thresholds), True))
                break
            if c > -1 and c >= deepest:
                failures[c] += 1
                deepest = c if failures[c] > patience.failures // 5 else deepest
                if failures[c] > patience.failures:
                    thresholds[c] += max(0.01, thresholds[c] / 10)
                    failures[c] = 0
                    thresholds[c + 1 :], failures[c + 1 :] = start[c + 1 :], [0] * (5 - c)
                    relaxations += 1
                    code = codes()
            if tries >= patience.attempts:
                found.append((None, list(thresholds), False))
                break
    return found, relaxations


@pytest.mark.parametrize("patience", [candidates.Patience(4, 1000), candidates.Patience(3, 25)])
def test_batches_equal_a_plain_loop(spark, profile, patience):
    start = [0.35, 0.1, 0.1, 0.1, 0.1, 0.1]
    expected, relaxations = plain(spark, profile, 4, start, patience)
    assert relaxations > 3
    for batch in (7, 600):
        got = candidates.accepted(spark, profile, 4, start, batch, patience)
        assert [f.passed for f in got] == [x[2] for x in expected]
        assert [f.nums for f in got if f.passed] == [x[0] for x in expected if x[2]]
        assert all(f.thresholds == pytest.approx(x[1]) for f, x in zip(got, expected, strict=True))


def test_measurements_agree_with_validation(spark, profile):
    own = candidates.random_tickets(spark, 400, 6).union(spark.createDataFrame([(900, [1, 1, 2, 3, 4, 5]), (901, [1, 2]), (902, [])], "ticket_id bigint, nums array<int>"))
    rows = {r["ticket_id"]: r for r in constraints.measured(own, profile).collect()}
    for t in ([0.9, 0.3, 0.3, 0.2, 0.2, 0.3], [0.5, 0.2, 0.2, 0.2, 0.2, 0.1], [1.0] * 6):
        for r in constraints.validate(own, profile, tuple(t)).collect():
            x = rows[r["ticket_id"]]
            assert constraints.first_failure(x["sound"], x["needs"], x["sum_good"], t) == r["code"]


def test_calibration_moves_and_rules_count(spark, profile):
    start = [0.35, 0.1, 0.1, 0.1, 0.1, 0.1]
    free = generation.calibrated(spark, [profile], start, 5, 500, candidates.Patience(5, 500)).first()
    assert free["passed"] == 5 and free["thr"] != start and all(a >= b - 1e-9 for a, b in zip(free["thr"], start, strict=True))
    found = candidates.accepted(spark, profile, 5, start, 500, candidates.Patience(5, 500))
    first = found[0].nums
    rules = spark.createDataFrame([([first[0]], next(x for x in range(1, 81) if x not in first), 0.5)], "antecedent array<int>, consequent int, confidence double")
    soft = candidates.accepted(spark, profile, 5, start, 500, candidates.Patience(5, 500), rules)
    assert soft[0].nums == first and soft[0].thresholds == pytest.approx([t + 0.05 for t in found[0].thresholds])
    hard = candidates.accepted(spark, profile, 5, start, 500, candidates.Patience(5, 500), rules, "hard")
    assert first not in [f.nums for f in hard] and len(hard) == 5


def test_tickets_that_did_not_pass_are_marked(spark, profile):
    got = candidates.generate(spark, profile, 3, [0.0] * 6, 50, candidates.Patience(10_000, 20)).collect()
    assert len({tuple(r["nums"]) for r in got}) == 3 and not any(r["passed"] for r in got)
    assert candidates.generate(spark, profile, 3, [9.0] * 6, 200).where(F.col("passed")).count() == 3
