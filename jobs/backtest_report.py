"""Backtest report: every issue's ticket, at several sizes, against the draw that follows it.

    spark-submit jobs/backtest_report.py --lineitem PATH --output PATH [--config FILE]

Draws and tickets are derived from order lines; a ticket of k numbers is the first k of its issue's order. The report has
one row for each number of hits, and one with hits null for all, by pick and block of issues. A file costs far more than
its rows, so a partition holds a span of 1,000 blocks and has the number of the first:

    pick=K/block=B/          hits, tickets, prize, stake, return_rate, own_block

A run replaces the partitions it computes and no others: repeated, it leaves the same table; with `first` or `last` (issues)
it renews the spans that these cut, whole. The newest draw has no follower, so its ticket waits for the next run. Earlier
tables have a partition for each block, without own_block; one that was written after its span takes the place of that
block, one that is older has been renewed and doesn't count.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from drawlens.functions.places import places
from drawlens.operators import payout
from drawlens.sources.draws import placed, sets
from jobs import common

log = logging.getLogger("jobs.backtest_report")

CONFIG = Path(__file__).with_suffix(".json")
REPORT = "hits int, tickets bigint, prize decimal(20,2), stake bigint, return_rate double, pick int, block bigint"
STORED = REPORT.replace("pick int", "own_block bigint, pick int")
SPAN = 1000  # blocks in a partition


@dataclass(frozen=True)
class Config:
    """picks: sizes of tickets; block: issues that a row counts; stake: of a ticket; first, last: issues to renew, all if unset."""

    picks: tuple[int, ...]
    block: int = 100
    stake: int = 2
    first: int | None = None
    last: int | None = None


def hits(lineitem: DataFrame, picks: tuple[int, ...]) -> DataFrame:
    """(issue, pick, hits) of every ticket whose draw has a follower."""
    return hits_of_buckets(sets(lineitem), picks)


def hits_of_buckets(buckets: DataFrame, picks: tuple[int, ...]) -> DataFrame:
    """hits of sets(lineitem). A bucket meets the one that follows it as bits, once for all sizes; none has a row for each number."""
    numbered = places(buckets.where("issue is not null"), "issue")
    following = numbered.select((F.col("place") - 1).alias("place"), F.struct("issue", "w0", "w1", "w2").alias("next"))
    # Bits are few bytes for much work, so the number of tasks is given; neighbours stay together, as blocks of them are counted.
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = numbered.join(following, "place").repartition(tasks, F.floor(F.col("issue") / 100))
    tickets = placed(spread, 41, max(picks)).select(F.col("issue").alias("own"), F.col("placed.num").alias("ticket"), "next.*")
    both = placed(tickets).select(F.col("own").alias("issue"), "ticket", F.col("placed.num").alias("drawn"))
    count = lambda k: F.size(F.array_intersect(F.filter(F.slice("ticket", 1, k), lambda n: n.isNotNull()), "drawn"))
    return both.select("issue", F.explode(F.array(*[F.struct(F.lit(k).alias("pick"), count(k).alias("hits")) for k in picks])).alias("x")).select("issue", "x.pick", "x.hits")


def report(scored: DataFrame, config: Config) -> DataFrame:
    """(hits, tickets, prize, stake, return_rate, pick, block) of (issue, pick, hits)."""
    amounts = payout.prizes(scored.sparkSession)
    blocks = scored.withColumn("block", F.floor(F.col("issue") / config.block).cast("bigint"))
    counts = blocks.groupBy("pick", "block", "hits").agg(F.count("*").alias("tickets"))
    paid = counts.join(F.broadcast(amounts), ["pick", "hits"], "left").withColumn("prize", F.coalesce("amount", F.lit(0)) * F.col("tickets"))
    out = paid.rollup("pick", "block", "hits").agg(F.sum("tickets").alias("tickets"), F.sum("prize").cast("decimal(20,2)").alias("prize")).where("block is not null")
    staked = out.withColumn("stake", F.col("tickets") * config.stake)
    return staked.select("hits", "tickets", "prize", "stake", F.round(F.col("prize").cast("double") / F.col("stake") * 100, 4).alias("return_rate"), "pick", "block")


def run(spark: SparkSession, lineitem: str, output: str, config: Config) -> None:
    read, wrote = Observation("read"), Observation("wrote")
    buckets = sets(spark.read.parquet(lineitem)).persist()
    try:
        scored, span = hits_of_buckets(buckets, config.picks), F.floor(F.floor(F.col("issue") / config.block) / SPAN)
        if config.first is not None:
            scored = scored.where(span >= config.first // config.block // SPAN)
        if config.last is not None:
            scored = scored.where(span <= config.last // config.block // SPAN)
        scored = scored.observe(read, F.count(F.lit(1)).alias("tickets"), F.min("issue").alias("first"), F.max("issue").alias("last"))
        rows = report(scored, config).withColumnRenamed("block", "own_block").observe(wrote, F.count(F.lit(1)).alias("rows"))
        spans = rows.withColumn("block", F.col("own_block") - F.pmod("own_block", F.lit(SPAN)))
        # A partition of the table is one file of one task; the number of tasks is given, as small tables would else come to one.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spans.repartition(tasks, "pick", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pick", "block").parquet(output)
    finally:
        buckets.unpersist()
    got = read.get
    log.info("scored %s tickets of issues %s to %s from %s, wrote %s rows to %s", got["tickets"], got["first"], got["last"], lineitem, wrote.get["rows"], output)


def read_report(spark: SparkSession, output: str) -> DataFrame:
    stored = common.read_or_empty(spark, output, STORED, modified=True)
    block = F.coalesce("own_block", "block")
    found = stored.withColumns({"alone": F.col("own_block").isNull(), "block": block, "span": F.floor(block / SPAN)})
    written = lambda which, *by: F.max(F.when(which, F.col("modified"))).over(Window.partitionBy("pick", *by))
    later = written(F.col("alone"), "span", "block") > written(~F.col("alone"), "span")
    counts = found.withColumn("counts", F.coalesce(later, F.col("alone")) == F.col("alone")).where("counts")
    return counts.select("hits", "tickets", "prize", "stake", "return_rate", "pick", "block")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Write the backtest report.")
    for name in ("lineitem", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(arguments)
    spark = common.session("backtest_report")
    try:
        run(spark, given.lineitem, given.output, common.configured(Config, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
