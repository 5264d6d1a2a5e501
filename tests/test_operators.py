"""Operators against plain restatements, hand-made literals and properties."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.functions import columns as C
from drawlens.functions.places import places
from drawlens.operators import adaptation, backtest, candidates, constraints, features, generation, metrics, pairs, payout
from drawlens.sources import files
from drawlens.sources.draws import as_arrays, derived, history, ranked, recent, recent_derived


def numbers(spark, draws):
    return spark.createDataFrame([(issue, n) for issue, own in draws for n in own], "issue bigint, num int")


@pytest.fixture(scope="module")
def draws():
    """Numbers of least remainder modulo a prime that changes from draw to draw."""
    return [(2023500 - i, sorted(sorted(range(1, 81), key=lambda x, i=i: (x * (2 * i + 17) % 83 * (i + 3)) % 89)[:20])) for i in range(60)]


@pytest.fixture(scope="module")
def h(spark, draws):
    return recent(numbers(spark, draws), 60).cache()


def test_as_of_cut_is_strict(spark, draws):
    cut = recent(numbers(spark, draws), 5, before=2023490)
    assert cut.agg(F.max("issue")).first()[0] == 2023489


def test_recent_draws_are_found_in_one_pass_and_read_nothing_more(spark, tmp_path):
    lines = spark.range(40_000).selectExpr("id div 4 AS l_orderkey", "xxhash64(id) AS l_partkey").unionByName(spark.createDataFrame([(None, i) for i in range(90)], "l_orderkey bigint, l_partkey bigint"))
    lines.write.parquet(str(tmp_path / "lines"))
    read = spark.read.parquet(str(tmp_path / "lines"))
    for before in (None, 2020500):
        every = derived(lines).where("issue IS NOT NULL" if before is None else f"issue < {before}")
        issues = sorted((r[0] for r in every.select("issue").distinct().collect()), reverse=True)[:30]
        expected = sorted((issues.index(r["issue"]), r["issue"], r["num"]) for r in every.where(F.col("issue") >= issues[-1]).collect())
        assert len(issues) == 30
        for h in (recent_derived(read, 30, before), recent(derived(read), 30, before)):
            assert h.schema.simpleString() == "struct<rn:int,issue:bigint,num:int>"
            assert not h.inputFiles() and sorted(map(tuple, h.collect())) == expected
    assert recent_derived(read.limit(0), 5).count() == 0


def test_hot_cold_ties_go_to_smaller_numbers(spark):
    h = recent(numbers(spark, [(1, range(1, 21)), (2, range(1, 21))]), 2)
    rows = {r["num"]: r["kind"] for r in metrics.hot_cold(h).collect()}
    assert [n for n, k in rows.items() if k == "hot"] == list(range(1, 11)) and [n for n, k in sorted(rows.items()) if k == "cold"] == list(range(71, 81))


def test_subset_sums_equal_enumeration(spark):
    nums = [1, 5, 9, 20, 33, 70]
    high = list(range(66, 81))
    for nums, k in ((nums, 1), (nums, 3), (nums, 4), (high, 12), (high, 15)):
        row = spark.range(1).select(C.subset_sums(F.array(*map(F.lit, nums)), k).alias("c")).first()["c"]
        expected = [0] * len(row)
        for own in combinations(nums, k):
            expected[sum(own)] += 1
        assert list(row) == expected


@pytest.mark.parametrize("nums, expected", [([4, 5, 11, 12, 13, 14, 40], [2, 4]), ([2, 20, 33, 79], []), ([78, 79, 80], [3]), ([], [])])
def test_run_lengths(spark, nums, expected):
    row = spark.range(1).select(C.run_lengths(F.array(*map(F.lit, nums)).cast("array<int>")).alias("r")).first()
    assert list(row["r"]) == expected


def test_rates_sum_to_one(h):
    assert abs(sum(metrics.parity(h).first()) - 1) < 1e-5
    assert abs(sum(r["rate"] for r in metrics.decade_groups(h).collect()) - 1) < 1e-5
    assert sum(r["draws"] for r in metrics.repeat_histogram(h, 50).collect()) == 50


def test_mutual_information_is_not_negative(h):
    rows = pairs.mutual_information(h).collect()
    assert len(rows) == 3160 and all(r["mi"] >= 0 for r in rows)


def test_tickets_against_given_rules(spark):
    rules = spark.createDataFrame([([70], 9, 0.5), ([33, 48], 12, 0.8), ([12], 61, 0.25)], "antecedent array<int>, consequent int, confidence double")
    tickets = {0: [33, 48, 70], 1: [9, 61, 70], 2: [33, 50, 51], 3: [12, 33, 48], 4: [12, 33, 48, 61]}
    own = spark.createDataFrame(list(tickets.items()), "ticket_id bigint, nums array<int>")
    broken = {0: 2, 1: 0, 2: 0, 3: 1, 4: 0}
    told = {(r["ticket_id"], *r["antecedent"], r["consequent"]) for r in pairs.violations(own, rules).collect()}
    assert told == {(0, 70, 9), (0, 33, 48, 12), (3, 12, 61)}
    for mode in ("hard", "soft"):
        got = {r["ticket_id"]: r for r in pairs.filter_tickets(own, rules, mode, 0.2).collect()}
        assert {i: r["violated"] for i, r in got.items()} == broken
        assert {i: r["accepted"] for i, r in got.items()} == {i: mode == "soft" or not n for i, n in broken.items()}
        assert {i: round(r["penalty"], 6) for i, r in got.items()} == ({0: 0.16, 1: 0, 2: 0, 3: 0.05, 4: 0} if mode == "soft" else dict.fromkeys(broken, 0))


def test_scores_are_bounded_and_ranked(h):
    rows = features.enhanced_scores(h, 60).collect()
    assert len(rows) == 80 and sorted(r["place"] for r in rows) == list(range(1, 81))
    assert all(-1e-9 <= r[c] <= 1 + 1e-9 for r in rows for c in ("recency", "momentum", "cooc", "dirichlet", "pca"))


def test_copula_needs_draws_and_repeats(h):
    with pytest.raises(ValueError):
        candidates.copula_tickets(h, 5)
    a, b = (candidates.copula_tickets(h, 5, min_draws=10).collect() for _ in range(2))
    assert a == b and all(len(set(r["nums"])) == 20 for r in a)


def test_payout_literals(spark):
    own = spark.createDataFrame([(0, 1, list(range(1, 11))), (1, 1, list(range(61, 71))), (2, 1, [1])], "ticket_id bigint, issue bigint, nums array<int>")
    drawn = spark.createDataFrame([(1, list(range(1, 21)))], "issue bigint, nums array<int>")
    rows = {r["ticket_id"]: (r["hits"], float(r["amount"])) for r in payout.score(own, drawn).collect()}
    assert rows == {0: (10, 5000000.0), 1: (0, 2.0), 2: (1, 4.6)}
    assert float(payout.score(own, drawn, strict_reference=True).where("ticket_id = 1").first()["amount"]) == 0


def test_validation_codes(spark, h):
    p = constraints.profile(h, 30, 10)
    own = spark.createDataFrame([(0, list(range(1, 10))), (1, [1, 1, *range(2, 10)]), (2, list(range(1, 20, 2))), (3, list(range(1, 20, 2)))], "ticket_id bigint, nums array<int>")
    rows = {r["ticket_id"]: r["code"] for r in constraints.validate(own, p, (1.1, 1.1, 0.1, 1, 1, 1)).collect()}
    assert rows[0] == -1 and rows[1] == -1 and rows[2] == 2 and rows[3] == -1


def test_random_tickets_do_not_depend_on_partitions(spark):
    a = candidates.random_tickets(spark, 50, 10).collect()
    assert len({tuple(r["nums"]) for r in a}) == 50 and all(len(r["nums"]) == 10 for r in a)


def test_history_layouts(spark, tmp_path):
    header = ",".join(["期数", *[f"红球_{i}" for i in range(1, 21)]])
    row = ",".join(["2024001", *[f"{i:02d}" for i in range(1, 21)]])
    (tmp_path / "b.csv").write_text(f"{header}\n{row}\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text(f",{header}\n0,{row}\n", encoding="utf-8")
    for name in ("a", "b"):
        rows = files.read_history(spark, str(tmp_path / f"{name}.csv")).collect()
        assert {r["issue"] for r in rows} == {2024001} and sorted(r["num"] for r in rows) == list(range(1, 21))
    (tmp_path / "c.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        files.read_history(spark, str(tmp_path / "c.csv"))


def test_sequence_text(spark):
    lines = spark.createDataFrame([("2024001 " + " ".join(map(str, range(20, 0, -1))) + ",x",), ("short 1 2",), (None,)], "value string")
    rows = files.parse_sequence(lines).collect()
    assert len(rows) == 1 and list(rows[0]["nums"]) == list(range(20, 0, -1))


def test_results_round_trip(spark, tmp_path):
    own = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8, 9])], "ticket_id bigint, nums array<int>")
    files.write_results(own, str(tmp_path / "out"), 3)
    assert sorted(list(r["nums"]) for r in files.read_results(spark, str(tmp_path / "out")).collect()) == [[1, 2, 3], [4, 5, 6], [7, 8, 9]]


def test_empty_history(spark):
    empty = spark.createDataFrame([], "rn int, issue bigint, num int")
    assert metrics.frequencies(empty).agg(F.sum("cnt")).first()[0] == 0
    assert as_arrays(empty).count() == 0 and metrics.hot_cold(empty).count() == 0


def test_streaming_counts(spark, tmp_path):
    import datetime as dt

    from drawlens.streaming import events

    rows = [(i, dt.datetime(2024, 1, 1, i % 3), 1, "a", 1.0, "{}") for i in range(9)]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), frame.schema))
    job = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [3, 3, 3]


def test_whole_histories(spark):
    """Operators whose input is whole see every draw."""
    from drawlens.plans.queries import queries

    sf = "/root/testdata/sf0.001"
    from drawlens.sources.draws import draw_numbers

    draws = draw_numbers(spark, sf).select("issue").distinct().count()
    rows = {name: queries()[name](spark, sf).count() for name in ("parse_tables", "sequence_text_parse", "sampled_results", "window_features")}
    assert rows == {"parse_tables": draws, "sequence_text_parse": draws, "sampled_results": -(-draws // 3), "window_features": draws - 3} and draws > 100
    assert {r["tickets"] for r in queries()["backtest_grid"](spark, sf).collect()} == {draws - 1}


def test_rate_divergence_has_six_metrics(spark, draws):
    h = recent(numbers(spark, draws), 51)
    got = {r["win"]: r for r in metrics.rate_divergence(h).collect()}
    assert list(got) == ["3", "5", "7", "9", "avg", "max", "mode0", "mode1", "mode2"]
    for r in metrics.window_divergence(h).collect():
        assert (got[str(r["win"])]["parity_diff"], got[str(r["win"])]["group_diff"]) == pytest.approx((r["parity_diff"], r["group_diff"]), abs=2e-5)
    for c in (f"{m}_diff" for m in metrics.METRICS):
        own = [got[w][c] for w in "3579"]
        assert got["avg"][c] == pytest.approx(sum(own) / 4, abs=2e-5) and got["max"][c] == pytest.approx(max(own), abs=1e-9)
    assert all(got["mode2"][f"{m}_diff"] == max(got["max"][f"{m}_diff"], b) for m, b in zip(metrics.METRICS, metrics.BASE, strict=True))


def test_chi_square_tail_at_known_quantiles():
    for statistic, dof, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (16.918978, 9, 0.05), (23.209251, 10, 0.01), (100.748619, 79, 0.05)):
        assert abs(metrics.chi_square_tail(statistic, dof) - p) < 1e-6
    assert metrics.chi_square_tail(0.0, 79) == 1.0


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_windows_adapt_as_in_a_walk(spark, block):
    differences = [abs((i * i * 37 + 11 * i) % 101 / 101 - (0.9 if i // 40 % 2 else 0.3)) / 8 for i in range(200)]
    level, expected = 0, []
    for i in range(200):
        seen = differences[max(0, i - 19) : i + 1]
        mean = round(sum(seen) / len(seen), 10)
        level = min(max(level + (0 if len(seen) < 10 else 1 if mean > 0.045 else -1 if mean < 0.042 else 0), 0), 3)
        expected.append((3, 5, 7, 9, 11, 13, 15)[: 4 + level])
    df = spark.createDataFrame(list(enumerate(differences)), "place bigint, difference double").repartition(3)
    got = {r["place"]: tuple(r["windows"]) for r in adaptation.adapted(df, grow=0.045, shrink=0.042, block=block).collect()}
    assert [got[i] for i in range(200)] == expected and len(set(expected)) == 4


def test_thresholds_come_back(spark, tmp_path):
    rows = [(5, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), (10, [0.05] * 6)]
    files.write_thresholds(spark.createDataFrame(rows, "pick int, thr array<double>"), f"{tmp_path}/t")
    assert sorted((r["pick"], list(r["thr"])) for r in files.read_thresholds(spark, f"{tmp_path}/t").collect()) == rows


def test_penalties_order_results_and_rejected_ones_go(spark):
    rows = [(1, [1], 0.2, True), (2, [2], 0.0, True), (3, [3], 0.0, False), (4, [4], 0.1, True), (5, [5], 0.0, True)]
    got = generation.penalised(spark.createDataFrame(rows, "ticket_id int, nums array<int>, penalty double, accepted boolean"), F.array(F.lit(0.5), F.lit(0.1))).collect()
    assert [(r["ticket_id"], r["thr"]) for r in got] == [(2, [0.5, 0.1]), (5, [0.5, 0.1]), (4, [0.6, 0.2]), (1, [0.7, 0.3])]


def test_best_of_the_union_passes_or_is_the_first(spark, h):
    p = constraints.profile(h, 20, 5)
    scores = features.recency_momentum(h).withColumn("combined", F.col("recency"))
    own = spark.createDataFrame([(0, "a", [1, 2, 3, 4, 5]), (1, "b", [6, 22, 37, 51, 78])], "ticket_id bigint, source string, nums array<int>")
    information = pairs.mutual_information(h)
    none = generation.best(own, p, (0.0,) * 6, scores, information).collect()
    assert [r["ticket_id"] for r in none if r["chosen"]] == [0] and all(r["code"] != 99 for r in none)
    assert sum(r["chosen"] for r in generation.best(own, p, (2.0,) * 6, scores, information).collect()) == 1


def test_repeat_distance(spark, h):
    p = constraints.profile(h, 20, 5)
    for nums in ([1, 2, 3, 4, 5], p.newest[:5], sorted([*p.newest[:2], *[x for x in range(1, 81) if x not in p.newest][:3]])):
        overlap = len(set(nums) & set(p.newest))
        expected = sum(abs(x - (i == overlap)) for i, x in enumerate(p.repeat) if i)
        got = spark.range(1).select(generation.repeat_distance(F.array(*map(F.lit, nums)), p).alias("x")).first()["x"]
        assert abs(got - expected) < 1e-9


@pytest.mark.parametrize("ranges", [1, 3, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_places(spark, ranges, descending):
    values = [5, -3, 10**12, 7, 0, 42, 41, 2, None]
    df = spark.createDataFrame([(v, 1) for v in values], "v bigint, w int").repartition(3)
    order = sorted(values, key=lambda v: (v is not None, v or 0), reverse=descending)
    got = {r["v"]: r["place"] for r in places(df, "v", descending=descending, ranges=ranges).collect()}
    assert got == {v: i for i, v in enumerate(order, 1)}
    assert places(df.where("v > 10e15"), "v").collect() == []


def test_places_cut_the_work(spark, capsys):
    """Only the sizes of the ranges are added up in one task, and a backtest has no nested loop."""
    numbers = spark.range(2000).selectExpr("id as issue", "cast(id % 80 + 1 as int) as num")
    history(numbers).explain("formatted")
    windows = [x for x in capsys.readouterr().out.split("\n\n") if "Window" in x.split("\n")[0] and "Arguments" in x]
    assert windows and all("_range" in x for x in windows)
    targets = numbers.select("issue")
    backtest.frequency_tickets(numbers, backtest.grid(targets, [4], 1), targets, 3).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_sampled_rows_in_order(spark):
    df = spark.range(1, 101).selectExpr("id * 3 as ticket_id").repartition(5)
    for modulus, remainder, most in ((7, 3, 4), (5, 0, None), (1, 0, 10)):
        own = [x for i, x in enumerate(range(3, 303, 3), 1) if i % modulus == remainder][:most]
        assert sorted(r["ticket_id"] for r in files.sample_rows(df, modulus, remainder, most=most).collect()) == own


def test_derived_draws_of_odd_lines(spark, capsys):
    """Null and negative parts are numbers too; lines meet their bucket in one exchange, without a window."""
    lines = [(10 * d + i % 10, None if i == 23 and d % 2 else (i * 7 + d * 3) * (-1 if i % 5 == 0 else 1)) for d in range(9) for i in range(26 if d != 4 else 15)]
    df = spark.createDataFrame(lines * 2, "l_orderkey bigint, l_partkey bigint")
    own = {}
    for o, p in lines:
        own.setdefault(o // 10, set()).add(None if p is None else (p % 80 if p >= 0 else -(-p % 80)) + 1)
    remainder = lambda x: x % 83 if x >= 0 else -(-x % 83)
    order = lambda d: lambda n: (n is not None, 0 if n is None else remainder(n * 37 + d * 11), n or 0)
    expected = {(d + 2020000, n, k) for d, nums in own.items() if len(nums) >= 20 for k, n in enumerate(sorted(nums, key=order(d))[:20], 1)}
    got = ranked(df)
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
    ranked(df).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_frequency_tickets_against_a_loop(spark, capsys):
    draws = {i * 3: sorted({(i * 7 + k * (3 + i % 4)) % 90 + 1 for k in range(6)}) for i in range(30)}
    numbers = spark.createDataFrame([(i, n) for i, own in draws.items() for n in own], "issue bigint, num int")
    targets = numbers.select("issue").distinct().where("issue > 6")
    tickets = backtest.frequency_tickets(numbers, backtest.grid(targets, [2, 40], 2), targets, 5)
    expected, issues = {}, sorted(draws)
    for at, issue in enumerate(issues):
        counts = Counter(n for i in issues[max(at - 5, 0) : at] for n in draws[i])
        order = sorted(counts, key=lambda n: (-counts[n], n))
        expected |= {(issue, p, r): sorted(order[r : r + p]) for p in (2, 40) for r in (0, 1) if issue > 6 and order[r : r + p]}
    assert {(r["issue"], r["pick"], r["run"]): r["nums"] for r in tickets.collect()} == expected
    tickets.explain()
    assert "row_number() windowspecdefinition(target" not in capsys.readouterr().out  # no row for each target and number
