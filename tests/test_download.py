"""The download path with transports of its own: no network."""

import sys

import pytest
from pyspark import cloudpickle

from drawlens.sources import download

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

HOSTS = frozenset({"lists.example.com"})


def replies(*given):
    """A transport that gives these replies one after another, and what it was asked."""
    asked, left = [], list(given)

    def transport(url, timeout):
        asked.append(url)
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return transport, asked


@pytest.mark.parametrize("url", ["http://lists.example.com.evil/x", "http://evil/lists.example.com", "http://lists.example.com@evil/", "ftp://lists.example.com/", "http://xlists.example.com/", "lists.example.com", ""])
def test_other_hosts_are_never_asked(url):
    transport, asked = replies((200, b"x"))
    text, attempts, error = download.fetch(url, transport, HOSTS)
    assert text is None and attempts == 0 and "not admitted" in error and not asked


def test_passing_failures_are_repeated_with_growing_pauses():
    transport, asked = replies((503, b""), OSError("no route"), (429, b""), (200, "ü\xff".encode("latin-1") + b"!"))
    pauses = []
    text, attempts, error = download.fetch("https://LISTS.example.com:443/a", transport, HOSTS, retries=3, backoff=1, sleep=pauses.append)
    assert text == "��!" and attempts == 4 and error is None and pauses == [1, 2, 4] and len(asked) == 4


@pytest.mark.parametrize(("given", "attempts"), [([(404, b"")], 1), ([(302, b"")], 1), ([(500, b"")] * 3, 3), ([OSError("x")] * 3, 3)])
def test_failures_are_told(given, attempts):
    transport, asked = replies(*given)
    text, made, error = download.fetch("http://lists.example.com/", transport, HOSTS, retries=2, sleep=lambda _: None)
    assert text is None and made == attempts == len(asked) and error


def table(first, last, less=()):
    rows = "".join(f"<tr class='t'><td> {i} </td>" + "".join(f"<td class=chartBall01>{(i * 7 + k) % 80 + 1:02d}</td>" for k in range(20)) + "<td>x</td></tr>" for i in range(first, last + 1) if i not in less)
    return f"<table><tbody id='tdata'><tr><td>issue</td></tr>{rows}<tr><td>9</td><td>01</td></tr></tbody></table>"


def serving(name, spark, refuse=(), less=()):
    """A source whose pages hold a table of the issues asked for."""
    def transport(url, timeout):
        first, last = (int(x) for x in url.rpartition("?")[2].split("-"))
        return (500, b"") if first in refuse else (200, table(first, last, less).encode())

    download.register(spark, name, transport)
    return {"url": "http://lists.example.com/h?{first}-{last}", "hosts": "other.example, lists.example.com", "step": 10, "retries": 0, "backoff": 0}


def held(df):
    return {r["issue"]: r["nums"] for r in df.collect()}


def expected(first, last):
    return {i: [(i * 7 + k) % 80 + 1 for k in range(20)] for i in range(first, last + 1)}


def test_ranges_are_partitions(spark):
    options = serving("ranges", spark, refuse=(20,))
    pages = spark.read.format("ranges").options(first=7, last=34, **options).load()
    assert pages.rdd.getNumPartitions() == 4
    got = {r["first"]: r for r in pages.collect()}
    assert sorted(got) == [0, 10, 20, 30] and got[20]["body"] is None and got[20]["error"] == "status 500"
    assert got[0]["url"].endswith("?7-9") and got[30]["url"].endswith("?30-34")


def test_download_keeps_what_fails_and_replaces_what_comes(spark, tmp_path):
    out = str(tmp_path / "history")
    assert download.load(spark, out).collect() == [] and not download.fresh(spark, out, 10**9)
    told = download.download(spark, "s1", out, first=3, last=25, **serving("s1", spark, refuse=(10,)))
    assert (told["pages"], told["failed"], told["draws"], told["latest_issue"]) == (3, 1, 20, 29)
    assert held(download.load(spark, out)) == expected(0, 9) | expected(20, 29)
    assert not download.fresh(spark, out, 10**9)  # a range failed
    options = serving("s2", spark, refuse=(20,), less=(12,))
    for _ in range(2):
        download.download(spark, "s2", out, first=10, last=29, **options)
        spark.catalog.refreshByPath(out)
        own = expected(0, 29)
        del own[12]
        assert held(download.load(spark, out)) == own  # range 20 failed: its draws stay
    assert held(download.load(spark, out, 5, 14)) == {i: v for i, v in own.items() if 5 <= i <= 14}
    assert sorted(held(download.load(spark, out, most=3))) == [27, 28, 29]
    assert download.runs(spark, out).count() == 3


def test_ensure_follows_flag_and_age(spark, tmp_path):
    out = str(tmp_path / "history")
    options = serving("s3", spark)
    assert download.ensure(spark, "s3", out, flag=0, first=0, last=9, **options).count() == 0
    assert held(download.ensure(spark, "s3", out, first=0, last=9, **options)) == expected(0, 9)
    assert download.fresh(spark, out, 3600) and not download.fresh(spark, out, 0)
    download.ensure(spark, "s3", out, first=0, last=19, **options)
    assert download.runs(spark, out).count() == 1  # fresh: not fetched again
    assert download.ensure(spark, "s3", out, ttl=0, first=0, last=19, **options).count() == 20
    assert download.runs(spark, out).count() == 2
