"""Fetching history pages as a Spark data source, and keeping what was fetched.

A source is made of a transport, `transport(url, timeout) -> (status, bytes)`, and registered under a name:

    register(spark, "history_pages", transport)
    spark.read.format("history_pages").options(url="https://host/list?start={first}&end={last}", first=1, last=500, step=50, hosts="host").load()

Each range of `step` issues is a partition and one request. Only hosts of the list are asked, by their exact name, before
any byte is sent; redirects are not followed, as they might leave the list. Requests that fail for a reason that may pass
(no connection, 429, 5xx) are repeated with growing pauses. A range that fails in the end is a row with its error, so that
one page never costs the others; what an earlier run stored for it stays.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

Transport = Callable[[str, float], tuple[int, bytes]]

PAGE = "first bigint, last bigint, url string, body string, attempts int, error string"
STORED = "issue bigint, nums array<int>, first bigint"
TOLD = "fetched_at timestamp, first bigint, last bigint, pages bigint, failed bigint, draws bigint, latest_issue bigint"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def web(url: str, timeout: float) -> tuple[int, bytes]:
    """The transport of the network: certificates are checked, redirects are not followed."""
    try:
        with urllib.request.build_opener(_Stay).open(url, timeout=timeout) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def archive(path: str, key: str) -> Transport:
    """A transport that answers `...?{first}-{last}` from a Parquet table instead of the network: its rows whose key is in
    the range, a JSON text a line. Workers must reach the path as files.
    """

    def transport(url: str, timeout: float) -> tuple[int, bytes]:
        import pyarrow.dataset as ds

        first, last = (int(x) for x in url.rpartition("?")[2].split("-"))
        rows = ds.dataset(path, format="parquet").to_table(filter=(ds.field(key) >= first) & (ds.field(key) <= last))
        return 200, "\n".join(json.dumps(r, ensure_ascii=False) for r in rows.to_pylist()).encode()

    return transport


def history_url(template: str, first: int, last: int) -> str:
    return template.replace("{first}", str(first)).replace("{last}", str(last))


def fetch(url: str, transport: Transport, hosts: frozenset[str], retries: int = 3, backoff: float = 0.5, timeout: float = 15, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """(text, attempts, error): one of text and error is None."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or (parts.hostname or "") not in hosts:
        return None, 0, f"host {parts.hostname} is not admitted"
    error = None
    for attempt in range(1, retries + 2):
        try:
            status, body = transport(url, timeout)
        except (OSError, http.client.HTTPException) as e:
            error = f"{type(e).__name__}: {e}"
        else:
            if status == 200:
                return body.decode("utf-8", "replace"), attempt, None
            error = f"status {status}"
            if status != 429 and status < 500:
                break
        if attempt <= retries:
            sleep(backoff * 2 ** (attempt - 1))
    return None, attempt, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.url, self.transport = options["url"], transport
        self.first, self.last, self.step = int(options["first"]), int(options["last"]), int(options.get("step", 50))
        self.hosts = frozenset(h.strip().lower() for h in options["hosts"].split(",") if h.strip())
        self.retries, self.backoff, self.timeout = int(options.get("retries", 3)), float(options.get("backoff", 0.5)), float(options.get("timeout", 15))
        if self.step < 1:
            raise ValueError("step must be positive")

    def partitions(self) -> list[InputPartition]:
        """Ranges begin at multiples of the step, whatever is asked, so that a range always has the same name."""
        starts = range(self.first // self.step * self.step, self.last + 1, self.step)
        return [InputPartition((s, max(s, self.first), min(s + self.step - 1, self.last))) for s in starts]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no range at all
            return
        start, first, last = partition.value
        url = history_url(self.url, first, last)
        text, attempts, error = fetch(url, self.transport, self.hosts, self.retries, self.backoff, self.timeout)
        yield start, last, url, text, attempts, error


def register(spark: SparkSession, name: str, transport: Transport = web) -> None:
    """Make a source of that transport known to the session."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, transport)

    spark.dataSource.register(Source)


def download(spark: SparkSession, source: str, output: str, **options: object) -> dict:
    """Fetches whole ranges, stores their draws and appends what happened to the metadata; returns the latter.

        draws/first=F/     the draws of a range, replaced when the range is fetched again
        metadata/          JSON, a row a run

    Ranges that fail, or hold no draw, keep what was stored for them.
    """
    step = int(options.get("step", 50))
    first, last = int(options["first"]) // step * step, (int(options["last"]) // step + 1) * step - 1
    pages, stored = Observation("pages"), Observation("stored")
    got = spark.read.format(source).options(**{**options, "first": first, "last": last, "step": step}).load()
    got = got.observe(pages, F.count(F.lit(1)).alias("pages"), F.count("error").alias("failed"))
    rows = files.parse_tables(got.select("first", "last", "body"), "body", keep=("first", "last")).where("issue between first and last").drop("last")
    rows = rows.observe(stored, F.count(F.lit(1)).alias("draws"), F.max("issue").alias("latest_issue"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("first").parquet(f"{output}/draws")
    told = {"first": first, "last": last, **pages.get, **stored.get}
    names = [c.split()[0] for c in TOLD.split(", ")]
    row = spark.createDataFrame([tuple(told.get(n) for n in names[1:])], TOLD.partition(", ")[2]).withColumn("fetched_at", F.current_timestamp()).select(*names)
    row.coalesce(1).write.mode("append").json(f"{output}/metadata")
    return told


def _known(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load(spark: SparkSession, output: str, first: int | None = None, last: int | None = None, most: int | None = None) -> DataFrame:
    """(issue, nums) of what is stored, between two issues if they are given, the newest `most` if that is.

    Ranges that lie wholly outside are not opened.
    """
    rows = _known(spark, f"{output}/draws", STORED, "parquet")
    if first is not None:
        rows = rows.where(F.col("issue") >= first)
    if last is not None:
        rows = rows.where((F.col("issue") <= last) & (F.col("first") <= last))
    rows = rows.select("issue", "nums")
    return rows if most is None else rows.orderBy(F.desc("issue")).limit(most)


def runs(spark: SparkSession, output: str) -> DataFrame:
    """What earlier runs told."""
    return _known(spark, f"{output}/metadata", TOLD, "json")


def fresh(spark: SparkSession, output: str, ttl: float) -> bool:
    """Whether a run without failures ended in the last `ttl` seconds."""
    young = F.col("fetched_at") > F.expr(f"current_timestamp() - make_dt_interval(0, 0, 0, {float(ttl)})")
    return bool(runs(spark, output).where((F.col("failed") == 0) & young).limit(1).count())


def ensure(spark: SparkSession, source: str, output: str, flag: int = 1, ttl: float = 300, **options: object) -> DataFrame:
    """The stored draws, after a download if flag is 1 and what is stored isn't fresh."""
    if int(flag) == 1 and not fresh(spark, output, ttl):
        download(spark, source, output, **options)
    return load(spark, output)
