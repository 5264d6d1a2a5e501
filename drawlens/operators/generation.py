"""What stands on all generators: their union with one score, thresholds learned from accepted tickets, rule penalties.

Everything that reaches the driver is a bounded number of tickets (parameters), whatever the length of the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import candidates, constraints
from .constraints import Profile

#: Which score orders the numbers in each mode.
MODES = {"hybrid": "combined", "momentum": "momentum", "cooccurrence": "cooc"}


def ranked_numbers(scores: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(num, score, place) of the 80 numbers by the score of the mode, ties to the smaller number."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    own = scores.select("num", F.col(MODES[mode]).alias("score"))
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "num")))


@dataclass(frozen=True)
class Amounts:
    """Tickets that each generator adds to the union, and how many there must be in all."""

    genetic: int = 5
    markov: int = 1
    copula: int = 10
    least: int = 3


def union(h: DataFrame, p: Profile, posterior: DataFrame, chances: dict[int, float], numbers: DataFrame, amounts: Amounts = Amounts(), min_draws: int = 180, seed: int = 42) -> DataFrame:
    """(ticket_id, source, nums): genetic, greedy, Markov, feature and copula tickets in this order, each set once.

    Too short a history leaves the copula out; too few tickets are filled by hot and cold quotas.
    """
    spark = h.sparkSession
    lists = lambda rows, n: [sorted(r["nums"]) for r in rows.limit(n).collect()]
    own = [("genetic", x) for x in lists(candidates.genetic_tickets(spark, p, best=amounts.genetic, seed=seed), amounts.genetic)]
    own.append(("greedy", candidates.greedy_ticket(posterior, p.pick)))
    if chances:
        own += [("markov", x) for x in lists(candidates.markov_tickets(spark, chances, amounts.markov, p.pick, seed), amounts.markov)]
    own.append(("feature", sorted(r["num"] for r in numbers.where(F.col("place") <= p.pick).collect())))
    seen: dict[tuple[int, ...], str] = {}
    for source, nums in own:
        if len(nums) == p.pick:
            seen.setdefault(tuple(nums), source)
    if amounts.copula and h.select("rn").distinct().count() >= min_draws:
        new = 0
        for nums in lists(candidates.copula_tickets(h, 3 * amounts.copula, topk=p.pick, min_draws=min_draws, seed=seed).orderBy("ticket_id"), 5 * amounts.copula):
            if new < amounts.copula and tuple(nums) not in seen:
                seen[tuple(nums)], new = "copula", new + 1
    while len(seen) < amounts.least:
        seed += 1
        for nums in lists(candidates.heuristic_tickets(spark, p, amounts.least, seed=seed), amounts.least):
            seen.setdefault(tuple(nums), "quota")
    return spark.createDataFrame([(i, source, list(nums)) for i, (nums, source) in enumerate(seen.items())], "ticket_id bigint, source string, nums array<int>")


def repeat_distance(nums: Column, p: Profile) -> Column:
    """Sum over overlaps from 1 of |share of the history - 1 for the ticket's own overlap with the newest draw, else 0|."""
    shares = F.array(*[F.lit(float(x)) for x in p.repeat])
    overlap = F.size(F.array_intersect(nums, constraints.ints(p.newest)))
    own = F.element_at(shares, F.least(overlap, F.lit(p.pick)) + 1)
    return F.lit(float(sum(p.repeat[1:]))) + F.when(overlap > 0, F.abs(own - 1) - own).otherwise(0.0)


def best(tickets: DataFrame, p: Profile, thresholds: tuple[float, ...], scores: DataFrame, information: DataFrame) -> DataFrame:
    """(ticket_id, source, nums, code, score, chosen): the chosen ticket is the passing one of the highest score, or the
    first ticket where none passes.
    """
    checked = constraints.validate(tickets.select("ticket_id", "nums"), p, thresholds)
    rows = constraints.rank(checked, p, scores, information).withColumn("score", F.round(F.col("score") - repeat_distance(F.col("nums"), p), 6))
    every = Window.orderBy(F.desc("passed"), F.when(F.col("passed") == 1, -F.col("score")), "ticket_id")  # a few tickets
    rows = rows.withColumn("chosen", F.row_number().over(every) == 1)
    return rows.join(F.broadcast(tickets.select("ticket_id", "source")), "ticket_id").select("ticket_id", "source", "nums", "code", "score", "chosen")


def calibrated(spark: SparkSession, profiles: list[Profile], thresholds: list[float], total: int = 50, batch: int = 2000, patience: candidates.Patience = candidates.Patience(), rules: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(pick, thr array of six, passed): for each profile the mean of the thresholds under which its tickets were found,
    rule penalties included, rounded to three places; and how many of them passed.
    """
    rows = []
    for p in profiles:
        own = candidates.accepted(spark, p, total, thresholds, batch, patience, rules, seed=seed)
        rows.append((p.pick, [round(sum(x) / len(x), 3) for x in zip(*(f.thresholds for f in own), strict=True)], sum(f.passed for f in own)))
    return spark.createDataFrame(rows, "pick int, thr array<double>, passed int")


def penalised(filtered: DataFrame, thresholds: Column) -> DataFrame:
    """(ticket_id, nums, thr): accepted tickets, their rule penalty added to every threshold, ordered by the vector.

    The order is a distributed sort: arrays compare as vectors do.
    """
    own = filtered.where("accepted").select("ticket_id", "nums", F.transform(thresholds, lambda t: F.round(t + F.col("penalty"), 6)).alias("thr"))
    return own.orderBy("thr", "ticket_id")
