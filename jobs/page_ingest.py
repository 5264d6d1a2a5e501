"""Ingests fetched pages as they arrive: keeps those of admitted hosts and stores the entries of their lists.

    spark-submit jobs/page_ingest.py --pages PATH --output PATH --checkpoint PATH [--config FILE]

Input is a folder of Parquet files (page_id, url, html) that grows, or one file; every run takes the files that no run has taken, some
at a time, and stops. A load writes

    items/load=N/tld=T/      page_id, host, pos, item, href: one row per list entry
    metadata/load=N/         JSON: pages read, refused (host not admitted), without entries, entries, least and greatest id

A load that is cut off is done again under its number and replaces its own folders only, so runs can be stopped and
repeated at any point. A host is admitted if it is one of the domains or below one of them: a name that merely begins or
ends like one is not. Pages without url or html have no host or no entries and are counted. A page that comes again in a
later load replaces its entries for readers of `read_items`.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from drawlens.sources import files
from jobs import common

log = logging.getLogger("jobs.page_ingest")

CONFIG = Path(__file__).with_suffix(".json")
ITEMS = "page_id bigint, host string, pos int, item string, href string, load bigint, tld string"
TLD = "none"  # of hosts without a dot


@dataclass(frozen=True)
class Config:
    """domains: hosts at or below them are admitted; files_per_load: new files taken at once."""

    domains: tuple[str, ...]
    files_per_load: int = 64


def admitted(host: Column, domains: tuple[str, ...]) -> Column:
    return F.coalesce(F.concat(F.lit("."), host).rlike(r"\.(" + "|".join(d.lower().replace(".", r"\.") for d in domains) + ")$"), F.lit(False))


def parsed(pages: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """page_id, host, entries (array) of every page; null entries where the host isn't admitted."""
    host = files.host_of(F.col("url"))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), "html")
    return own.select("page_id", "host", F.when(admitted(F.col("host"), domains), F.coalesce(files.list_entries(F.col("html")), F.array())).alias("entries"))


def store(batch: DataFrame, load: int, output: str, domains: tuple[str, ...]) -> dict:
    """Writes one load; the counts come with the write, the pages are read once."""
    seen = Observation(f"load-{load}")
    size = F.coalesce(F.size("entries"), F.lit(0))
    own = parsed(batch, domains).observe(
        seen,
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("entries").isNull(), 1)).alias("refused"),
        F.count(F.when(F.size("entries") == 0, 1)).alias("without_entries"),
        F.coalesce(F.sum(F.when(F.col("entries").isNotNull(), size)), F.lit(0)).alias("entries"),
        F.min("page_id").alias("least_page"),
        F.max("page_id").alias("greatest_page"),
    )
    tld = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise(TLD)
    rows = own.select("page_id", "host", F.posexplode("entries").alias("pos", "entry")).select("page_id", "host", "pos", F.col("entry.item").alias("item"), F.col("entry.href").alias("href"), F.lit(load).cast("bigint").alias("load"), tld.alias("tld"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", "tld").parquet(f"{output}/items")
    counts = seen.get
    kinds = "load bigint, pages bigint, refused bigint, without_entries bigint, entries bigint, least_page bigint, greatest_page bigint"
    row = batch.sparkSession.createDataFrame([(load, *(counts[k.split()[0]] for k in kinds.split(", ")[1:]))], kinds)
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").json(f"{output}/metadata")
    log.info("load %s: read %s pages (%s refused, %s without entries), wrote %s entries to %s", load, counts["pages"], counts["refused"], counts["without_entries"], counts["entries"], output)
    return counts


def as_pattern(path: str) -> str:
    """A pattern that matches just this path: streams take a plain path for a folder, patterns match single files too."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, pages: str, output: str, checkpoint: str, config: Config) -> int:
    """Takes all files that are new; returns how many pages were read."""
    schema = spark.read.parquet(pages).select("page_id", "url", "html").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_load).parquet(as_pattern(pages))
    read = []

    def load(batch: DataFrame, number: int) -> None:
        read.append(store(batch, number, output, config.domains)["pages"])

    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        if query.isActive:
            query.stop()
    log.info("%s loads, %s pages from %s", len(read), sum(read), pages)
    return sum(read)


def read_items(spark: SparkSession, output: str) -> DataFrame:
    """page_id, host, tld, pos, item, href: of every page the entries of its newest load."""
    rows = common.read_or_empty(spark, f"{output}/items", ITEMS)
    newest = rows.withColumn("newest", F.max("load").over(Window.partitionBy("page_id")))
    return newest.where(F.col("load") == F.col("newest")).select("page_id", "host", "tld", "pos", "item", "href")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Ingest the list entries of new pages.")
    for name in ("pages", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(arguments)
    spark = common.session("page_ingest")
    try:
        run(spark, given.pages, given.output, given.checkpoint, common.configured(Config, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
