"""Payout of tickets against draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRIZES


def prizes(spark: SparkSession) -> DataFrame:
    """(pick, hits, amount decimal): 65 rows."""
    rows = [(pick, pick - i, amount) for pick, own in PRIZES.items() for i, amount in enumerate(own)]
    return spark.createDataFrame(rows, "pick int, hits int, amount string").select("pick", "hits", F.col("amount").cast("decimal(12,2)").alias("amount"))


def score(tickets: DataFrame, draws: DataFrame, strict_reference: bool = False) -> DataFrame:
    """(ticket_id, issue, pick, hits, amount): tickets (ticket_id, issue, nums) against draws (issue, nums).

    strict_reference leaves out the prize for no hits at all, as the reference does.
    """
    hits = F.size(F.array_intersect("nums", "drawn"))
    met = tickets.join(draws.select("issue", F.col("nums").alias("drawn")), "issue").select("ticket_id", "issue", F.size("nums").alias("pick"), hits.alias("hits"))
    paid = met.join(F.broadcast(prizes(tickets.sparkSession)), ["pick", "hits"], "left")
    amount = F.coalesce("amount", F.lit(0).cast("decimal(12,2)"))
    if strict_reference:
        amount = F.when(F.col("hits") == 0, F.lit(0).cast("decimal(12,2)")).otherwise(amount)
    return paid.select("ticket_id", "issue", "pick", "hits", amount.alias("amount"))


def known_targets(tickets: DataFrame, draws: DataFrame) -> DataFrame:
    """tickets (ticket_id, issue, nums) with the latest draw's issue where no draw has theirs."""
    issues = draws.select("issue").distinct()
    latest = issues.agg(F.max("issue").alias("latest"))
    met = tickets.join(issues.withColumn("known", F.lit(True)), "issue", "left").join(F.broadcast(latest))
    return met.select("ticket_id", F.when(F.col("known"), F.col("issue")).otherwise(F.col("latest")).alias("issue"), "nums")


def by_hits(scored: DataFrame) -> DataFrame:
    return scored.groupBy("pick", "hits").agg(F.count("*").alias("tickets"), F.sum("amount").cast("decimal(20,2)").alias("prize"))


def returns(scored: DataFrame, group: str, stake: int = 2, least: float | None = None) -> DataFrame:
    """(group, tickets, prize, stake, return_rate %), and the total under a null group; `least` keeps groups at or above it."""
    out = scored.rollup(group).agg(F.count("*").alias("tickets"), F.sum("amount").cast("decimal(20,2)").alias("prize"))
    out = out.select(group, "tickets", "prize", (F.col("tickets") * stake).alias("stake"), F.round(F.col("prize").cast("double") / (F.col("tickets") * stake) * 100, 4).alias("return_rate"))
    return out if least is None else out.where((F.col("return_rate") >= least) & F.col(group).isNotNull())
