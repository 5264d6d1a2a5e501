"""What is kept between runs: mined rules, and reports of result files."""

import threading
import time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from drawlens.config import PRIZES
from drawlens.operators import rule_cache
from drawlens.operators.pairs import association_rules
from drawlens.plans.queries import queries
from drawlens.sources.draws import as_arrays, derived, placed_arrays, recent, sets
from drawlens.streaming import results


@pytest.fixture(scope="module")
def h(spark):
    rows = [(i, (i * 7 + k * (3 + i % 5)) % 80 + 1) for i in range(40) for k in range(20)]
    return recent(spark.createDataFrame(list(dict.fromkeys(rows)), "issue bigint, num int"), 40).cache()


def plain(rules):
    return sorted(repr((sorted(r["antecedent"]), *r[1:])) for r in rules.collect())


def versions(path):
    return len(list(Path(path, "rules").glob("key=*/version=*")))


def test_rules_are_mined_once_for_the_same_draws(spark, h, tmp_path):
    path, given = str(tmp_path), {"support": 0.3, "confidence": 0.5}
    expected = plain(association_rules(h, 0.3, 0.5))
    assert expected and plain(rule_cache.cached_rules(h, path, **given)) == expected
    assert plain(rule_cache.cached_rules(h.repartition(7).orderBy("num"), path, **given)) == expected and versions(path) == 1
    rule_cache.cached_rules(h, path, support=0.3, confidence=0.6)
    assert versions(path) == 2  # other parameters
    more = h.unionByName(spark.createDataFrame([(-1, 10_000, n) for n in range(1, 21)], "rn int, issue bigint, num int"))
    assert plain(rule_cache.cached_rules(more, path, **given)) == plain(association_rules(more, 0.3, 0.5)) and versions(path) == 3
    changed = h.where("not (rn = 3 and num = 1)").unionByName(h.where("rn = 3").limit(1).withColumn("num", F.lit(81)))
    assert rule_cache.cache_key(changed) != rule_cache.cache_key(h)


def test_rules_expire(h, tmp_path):
    path = str(tmp_path)
    rule_cache.cached_rules(h, path, 0.3, 0.5)
    time.sleep(1.1)
    rule_cache.cached_rules(h, path, 0.3, 0.5, ttl=1)
    assert versions(path) == 2
    rule_cache.cached_rules(h, path, 0.3, 0.5, ttl=0)  # of any age
    assert versions(path) == 2


def test_rules_without_a_manifest_row_are_not_seen(spark, h, tmp_path):
    path, key = str(tmp_path), rule_cache.cache_key(h)
    assert rule_cache.lookup(spark, path, key) is None
    association_rules(h, 0.3, 0.9).limit(1).write.parquet(f"{path}/rules/key={key}/version=half")  # a writer that died
    assert rule_cache.lookup(spark, path, key) is None
    rule_cache.publish(association_rules(h, 0.3, 0.5), path, key)
    assert plain(rule_cache.lookup(spark, path, key)) == plain(association_rules(h, 0.3, 0.5))


def test_two_writers_leave_whole_rules(spark, h, tmp_path):
    path, failed = str(tmp_path), []

    def write():
        try:
            rule_cache.publish(association_rules(h, 0.3, 0.5), path, "k")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and versions(path) == 2
    assert plain(rule_cache.lookup(spark, path, "k")) == plain(association_rules(h, 0.3, 0.5))


DRAWS = {100: range(1, 21), 101: range(21, 41)}


def money(tickets):
    return {k: (n, Decimal(p).quantize(Decimal("0.01"))) for k, (n, p) in tickets.items()}


def test_result_files_are_scored_once(spark, tmp_path):
    where, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    draws = spark.createDataFrame([(i, list(n)) for i, n in DRAWS.items()], "issue bigint, nums array<int>")
    tickets = lambda rows: spark.createDataFrame(rows, "issue bigint, nums array<int>")
    take = lambda: results.take(spark, where, draws, out, checkpoint)
    got = lambda: {(r["issue"], r["pick"], r["run"]): (r["tickets"], r["prize"]) for r in results.report(spark, out).collect()}
    results.write(tickets([(100, [1, 2, 3]), (100, [1, 2, 50]), (100, [60, 70, 80]), (999, [1, 2, 3])]), where, "a", 3)
    take()
    first = money({(100, 3, "a"): (3, Decimal(PRIZES[3][0]) + Decimal(PRIZES[3][1])), (999, 3, "a"): (1, 0)})
    assert got() == first
    assert {r["issue"]: r["known"] for r in results.report(spark, out).collect()} == {100: True, 999: False}
    take()
    assert got() == first
    time.sleep(1.1)  # files' times are in seconds
    results.write(tickets([(101, list(range(21, 31))), (101, list(range(31, 41)))]), where, "b", 10)
    take()
    both = first | money({(101, 10, "b"): (2, 2 * Decimal(PRIZES[10][0]))})
    assert got() == both
    newest = results.latest(results.report(spark, out)).first()
    assert (newest["issue"], newest["pick"]) == (101, 10) and newest["file"].startswith("pick=10/issue=101/run=b/")
    # The second load was written, but nobody knew: it is done again.
    for known in Path(checkpoint, "commits").glob("*1*"):
        known.unlink()
    take()
    assert got() == both
    assert [r["issue"] for r in results.report(spark, out, least=1000).collect()] == [101]


def test_no_results(spark, tmp_path):
    assert results.report(spark, f"{tmp_path}/none").collect() == []
    assert results.latest(results.report(spark, f"{tmp_path}/none")).first()["issue"] is None


def test_result_files_are_listed_by_few_tasks(spark, tmp_path):
    """Each load's files would else be a task each; the setting is as it was afterwards."""
    own = spark.createDataFrame([(i, [1, 2, 3]) for i in range(40)], "issue bigint, nums array<int>")
    results.write(own, f"{tmp_path}/in", "a", 3)
    before = spark.conf.get(results.LISTING)
    done = spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    results.take(spark, f"{tmp_path}/in", own, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    jobs = spark.sparkContext._jsc.sc().statusStore().jobsList(None)
    assert max(jobs.apply(i).numTasks() for i in range(jobs.size() - done)) < 40 and spark.conf.get(results.LISTING) == before
    assert results.report(spark, f"{tmp_path}/out").count() == 40


def test_result_files_hold_blocks_of_issues(spark, tmp_path):
    """A file for each block, a report row for each of its issues; files of one issue may lie beside them."""
    where, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    draws = spark.createDataFrame([(i, list(range(1, 21))) for i in range(-15, 45)], "issue bigint, nums array<int>")
    tickets = lambda rows: spark.createDataFrame(rows, "issue bigint, nums array<int>")
    got = lambda: {(r["issue"], r["pick"], r["run"]): (r["tickets"], r["prize"], r["known"]) for r in results.report(spark, out).collect()}
    won = lambda n, hits: (n, n * Decimal(PRIZES[3][3 - hits]).quantize(Decimal("0.01")), True)
    take = lambda: results.take(spark, where, draws, out, checkpoint)
    results.write(tickets([(i, [1, 2, 3 if i % 2 else 30]) for i in range(-15, 45)] + [(7, [4, 5, 6])]), where, "a", 3, block=20)
    results.write(tickets([(20, [1, 40, 50]), (99, [1, 2, 3])]), where, "b", 3)
    assert sorted(p.parts[-3] for p in Path(where).glob("pick=3/issue=*/run=a/*.csv")) == ["issue=-20", "issue=0", "issue=20", "issue=40"]
    expected = {(i, 3, "a"): won(2 if i == 7 else 1, 3 if i % 2 else 2) for i in range(-15, 45)} | {(20, 3, "b"): won(1, 1), (99, 3, "b"): (1, Decimal("0.00"), False)}
    take()
    take()
    assert got() == expected
    time.sleep(1.1)  # files' times are in seconds
    results.write(tickets([(41, list(range(31, 41))), (43, list(range(1, 11)))]), where, "c", 10, block=20)
    take()
    newest = results.latest(results.report(spark, out)).first()
    assert (newest["issue"], newest["pick"]) == (43, 10) and newest["file"].startswith("pick=10/issue=40/run=c/")


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test data")
def test_result_files_query_leaves_few_files(spark):
    """Files don't grow with the issues one by one; a file for each issue took most of the query's time."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("results-*"))
    issues = queries()["result_files"](spark, "/root/testdata/sf0.001").count()
    (own,) = set(shared.glob("results-*")) - before
    assert issues > 100 and len(list(own.glob("in/*/*/*/*.csv"))) == 2


def test_arrays_of_buckets_equal_grouped_numbers(spark):
    lines = [(10 * d + i % 10, (i * 7 + d * 3) % 80) for d in range(12) for i in range(24 if d != 4 else 15)] + [(None, i) for i in range(30)] + [(20, None), (31, -5)]
    df = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint")
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows.collect())
    for multiplier, size in ((37, 20), (41, 10)):
        assert plain(placed_arrays(sets(df), multiplier, size)) == plain(as_arrays(derived(df, multiplier, size)))
