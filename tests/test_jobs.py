"""The jobs: growing input, repeated and cut-off runs, settings, command lines, and SQL for their queries."""

import os
import re
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from drawlens.sources.draws import derived, ranked
from jobs import backtest_report, common, page_ingest
from jobs.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
PAGES = "page_id bigint, url string, html string, load int, host string"
ALL = page_ingest.Config(("example.com", "example.org"), 1)


def page(spark, rows, path, mode="append"):
    spark.createDataFrame([(*r, 9, "x") for r in rows], PAGES).coalesce(1).write.mode(mode).parquet(path)


def entries(rows, domains=("example.com", "example.org")):
    for i, url, html in rows:
        host = re.match(r"https?://([^/:?#]+)", url or "", re.I)
        host = host[1].lower() if host else ""
        if any(("." + host).endswith("." + d) for d in domains):
            for pos, (href, item) in enumerate(re.findall(r'<li>(?:<a(?:[^>]*?\shref="([^"]*)")?[^>]*>)?([^<]*)', html or "")):
                yield (i, host, host.rpartition(".")[2] if "." in host else "none", pos, item, href)


FIRST = [
    (1, "http://a.example.com/x", '<ul><li><a href="/u">one</a></li><li>two</li></ul>'),
    (2, "https://EXAMPLE.org:80/", "<li>three\nlines</li>"),
    (3, "http://example.com.evil/x", "<li>no</li>"),
    (4, "http://badexample.com/x", "<li>no</li>"),
    (5, None, "<li>no</li>"),
    (6, "http://example.com", None),
    (7, "nonsense", ""),
]
LATER = [(8, "http://b.example.com/", "<li>" + "long " * 50_000 + "</li>"), (8, "http://b.example.com/", "<li>again</li>"), (1, "http://a.example.com/x", '<li><a class="c" href="/new">new</a></li>'), (None, "http://example.com", "<li>without id</li>")]


def items(spark, out):
    return sorted(map(repr, map(tuple, page_ingest.read_items(spark, out).collect())))


def test_pages_are_taken_once_as_they_arrive(spark, tmp_path):
    pages, out, checkpoint = (f"{tmp_path}/{x}" for x in ("pages", "out", "checkpoint"))
    run = lambda: page_ingest.run(spark, pages, out, checkpoint, ALL)
    page(spark, FIRST, pages)
    assert run() == len(FIRST)
    assert items(spark, out) == sorted(map(repr, entries(FIRST)))
    page(spark, LATER, pages)
    assert run() == len(LATER)
    now = [r for r in FIRST if r[0] != 1] + LATER
    assert items(spark, out) == sorted(map(repr, entries(now)))
    assert run() == 0 and items(spark, out) == sorted(map(repr, entries(now)))
    told = {r["load"]: r for r in spark.read.json(f"{out}/metadata").collect()}
    assert (told[0]["pages"], told[0]["refused"], told[0]["without_entries"], told[0]["entries"], told[0]["least_page"], told[0]["greatest_page"]) == (7, 4, 1, 3, 1, 7)
    assert (told[1]["pages"], told[1]["refused"], told[1]["entries"]) == (4, 0, 4)
    # The last load was written, but cut off before it was known to be: it is done again and nothing is there twice.
    for known in Path(checkpoint, "commits").glob("*1*"):
        known.unlink()
    assert run() == len(LATER) and items(spark, out) == sorted(map(repr, entries(now)))
    assert spark.read.json(f"{out}/metadata").count() == 2


def test_one_file_and_no_pages(spark, tmp_path):
    page(spark, FIRST, f"{tmp_path}/pages")
    (file,) = Path(tmp_path, "pages").glob("*.parquet")
    assert page_ingest.run(spark, str(file), f"{tmp_path}/a", f"{tmp_path}/ca", ALL) == len(FIRST)
    assert items(spark, f"{tmp_path}/a") == sorted(map(repr, entries(FIRST)))
    page(spark, [], f"{tmp_path}/none")
    assert page_ingest.run(spark, f"{tmp_path}/none", f"{tmp_path}/b", f"{tmp_path}/cb", ALL) == 0
    assert items(spark, f"{tmp_path}/b") == []


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@needs_data
def test_report_is_repeated_renewed_and_grows(spark, tmp_path):
    config = common.configured(backtest_report.Config, backtest_report.CONFIG)
    whole, grown = f"{tmp_path}/whole", f"{tmp_path}/grown"
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.where("l_orderkey < 800").write.parquet(f"{tmp_path}/lines")
    backtest_report.run(spark, f"{tmp_path}/lines", grown, config)
    early = rows(backtest_report.read_report(spark, grown))
    lines.where("l_orderkey >= 800").write.mode("append").parquet(f"{tmp_path}/lines")
    for _ in range(2):
        backtest_report.run(spark, f"{tmp_path}/lines", grown, config)
    backtest_report.run(spark, f"{SF}/lineitem.parquet", whole, config)
    expected = rows(backtest_report.read_report(spark, whole))
    assert rows(backtest_report.read_report(spark, grown)) == expected != early
    # A damaged block is renewed by a run over one of its issues; the others are left alone.
    spoilt = backtest_report.read_report(spark, whole).where("block = 20201").selectExpr("hits", "tickets + 1 as tickets", "prize", "stake", "return_rate", "pick", "block")
    spoilt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pick", "block").parquet(grown)
    spark.catalog.refreshByPath(grown)
    assert rows(backtest_report.read_report(spark, grown)) != expected
    backtest_report.run(spark, f"{SF}/lineitem.parquet", grown, backtest_report.Config(config.picks, first=2020120, last=2020120))
    spark.catalog.refreshByPath(grown)
    assert rows(backtest_report.read_report(spark, grown)) == expected


def test_hits_against_a_loop(spark):
    lines = [(10 * d + i % 10, (i * 7 + d * 3) % 80) for d in range(12) for i in range(24 if d != 4 else 15)]
    df = spark.createDataFrame([(o, p) for o, p in lines], "l_orderkey bigint, l_partkey bigint")
    own = {}
    for o, p in lines:
        own.setdefault(o // 10, set()).add(p % 80 + 1)
    own = {d: s for d, s in own.items() if len(s) >= 20}
    order = lambda d, m: sorted(own[d], key=lambda n: (n * m + d * 11) % 83)
    days = sorted(own)
    expected = {(a + 2020000, k): len(set(order(a, 41)[:k]) & set(order(b, 37)[:20])) for a, b in zip(days, days[1:], strict=False) for k in (2, 10)}
    assert {(r["issue"], r["pick"]): r["hits"] for r in backtest_report.hits(df, (2, 10)).collect()} == expected
    assert backtest_report.hits(df.where("l_orderkey < 0"), (2,)).collect() == []


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"picks": [1, 2], "block": 7}')
    assert common.configured(backtest_report.Config, path) == backtest_report.Config((1, 2), 7)
    path.write_text('{"pick": [1]}')
    with pytest.raises(ValueError, match="pick"):
        common.configured(backtest_report.Config, path)


@needs_data
@pytest.mark.parametrize("job", ["page_ingest", "backtest_report"])
def test_command_lines(spark, tmp_path, job):
    given = ["--pages", f"{SF}/pages.parquet", "--checkpoint", f"{tmp_path}/c"] if job == "page_ingest" else ["--lineitem", f"{SF}/lineitem.parquet"]
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), *given, "--output", f"{tmp_path}/out"], capture_output=True, text=True, timeout=300, cwd=tmp_path, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job}" in done.stderr or "__main__" in done.stderr
    assert (page_ingest.read_items(spark, f"{tmp_path}/out") if job == "page_ingest" else backtest_report.read_report(spark, f"{tmp_path}/out")).count()


@needs_data
@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    plain = lambda x: round(float(x), 4) if isinstance(x, (float, Decimal)) else x
    expected = [dict(zip([c[0] for c in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    got = queries()[name](spark, SF)
    assert columns == sorted(got.columns)
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[c]) for c in columns]) for r in expected)


def test_jobs_stand_alone():
    text = "".join(p.read_text() for p in [*(ROOT / "jobs").glob("*.py")])
    assert "drawlens.llm" not in text and "corpus_pipeline" not in text


@needs_data
def test_a_partition_of_the_report_is_one_file(spark, tmp_path):
    backtest_report.run(spark, f"{SF}/lineitem.parquet", f"{tmp_path}/out", common.configured(backtest_report.Config, backtest_report.CONFIG))
    files = [p.parent for p in Path(tmp_path, "out").glob("pick=*/block=*/*.parquet")]
    assert files and len(files) == len(set(files))


@needs_data
def test_report_leaves_a_file_for_each_span(spark, tmp_path):
    """Blocks lie together in few files: a partition for each took most of the time of a long history."""
    config = backtest_report.Config((1, 10), block=1)
    backtest_report.run(spark, f"{SF}/lineitem.parquet", f"{tmp_path}/out", config)
    report = backtest_report.read_report(spark, f"{tmp_path}/out")
    files = [p.parent.relative_to(tmp_path / "out").as_posix() for p in Path(tmp_path, "out").rglob("*.parquet")]
    assert report.select("block").distinct().count() > 100 and len(files) == 2
    assert {tuple(f.split("/")[0].split("=")) for f in files} == {("pick", "1"), ("pick", "10")}
    totals = {(r["pick"], r["block"]): r["tickets"] for r in report.where("hits is null").collect()}
    assert len(totals) == 2 * report.select("block").distinct().count() and set(totals.values()) == {1}


def test_spans_are_renewed_whole_and_alone(spark, tmp_path):
    """Issues on both sides of a bound of two spans; a run over one of them leaves the other as it was, and other sizes too."""
    lines = [(10 * d + i % 10, (i * 7 + d * 3) % 80) for d in range(-5, 12) for i in range(24)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lines")
    run = lambda *given, **more: backtest_report.run(spark, f"{tmp_path}/lines", f"{tmp_path}/out", backtest_report.Config(*given, block=1, **more))
    got = lambda: rows(backtest_report.read_report(spark, f"{tmp_path}/out"))
    run((2, 10))
    whole = got()
    assert {p.parent.name for p in Path(tmp_path, "out").rglob("*.parquet")} == {"block=2019000", "block=2020000"}
    times = lambda: {p.parent: p.stat().st_mtime_ns for p in Path(tmp_path, "out").rglob("*.parquet")}
    before = times()
    run((10,), first=2020003, last=2020003)
    after = times()
    assert got() == whole and {(p.parent.name, p.name) for p in before if before[p] != after[p]} == {("pick=10", "block=2020000")}


def test_earlier_partitions_count_until_their_span_is_renewed(spark, tmp_path):
    """A table with a partition for each block is renewed in place, with nothing twice; those out of reach are kept."""
    lines = [(10 * d + i % 10, (i * 7 + d * 3) % 80) for d in range(-5, 12) for i in range(24)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lines")
    run = lambda out, **more: backtest_report.run(spark, f"{tmp_path}/lines", f"{tmp_path}/{out}", backtest_report.Config((2, 10), block=1, **more))
    read = lambda out: backtest_report.read_report(spark, f"{tmp_path}/{out}")
    run("whole")
    expected = rows(read("whole"))
    earlier = read("whole").withColumn("tickets", F.col("tickets") + 1)
    earlier = earlier.unionByName(earlier.where("block = 2020005").withColumn("block", F.lit(2020500).cast("bigint")))  # not in the lines any more
    earlier.repartition(3).write.partitionBy("pick", "block").parquet(f"{tmp_path}/out")  # several files for a block
    assert rows(read("out")) == rows(earlier)
    run("out", first=2020000)
    mixed = read("whole").where("block >= 2020000").unionByName(earlier.where("block < 2020000"))
    assert rows(read("out")) == rows(mixed)
    run("out")
    assert rows(read("out")) == expected


def test_hits_of_damaged_lines(spark):
    """Lines without an order or a part, negative ones, and buckets of fewer than 20 numbers, against the rows of derived draws."""
    lines = [(10 * d + i % 10, (i * 7 + d * 3) % 80) for d in range(8) for i in range(24 if d != 4 else 15)] + [(None, i) for i in range(30)] + [(20, None), (31, None), (41, -5), (61, -78)]
    df = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint")
    drawn = {i: {r["num"] for r in rs} for i, rs in grouped(derived(df))}
    own = {i: [r["num"] for r in sorted(rs, key=lambda r: r["rk"])] for i, rs in grouped(ranked(df, 41, 10))}
    issues = sorted(drawn)
    expected = {(a, k): len({n for n in own[a][:k] if n is not None} & drawn[b]) for a, b in zip(issues, issues[1:], strict=False) for k in (1, 5, 10)}
    assert len(expected) == 18 and {(r["issue"], r["pick"]): r["hits"] for r in backtest_report.hits(df, (1, 5, 10)).collect()} == expected


def grouped(df):
    found = {}
    for r in df.where("issue is not null").collect():
        found.setdefault(r["issue"], []).append(r)
    return found.items()
