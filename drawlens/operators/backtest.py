"""Backtests: tickets for a grid of parameters and target issues, scored in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import places
from ..sources.draws import as_arrays
from . import payout
from .frames import with_before


def grid(targets: DataFrame, picks: list[int], runs: int) -> DataFrame:
    """(issue, pick, run) for every combination."""
    return targets.select("issue", F.explode(F.array(*[F.lit(p) for p in picks])).alias("pick")).select("issue", "pick", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))


def most_frequent(before: Column, n: int) -> Column:
    """The n most frequent numbers of the draws (arrays) in before, the most frequent first, ties to the smaller number."""
    nums = F.sort_array(F.flatten(before))
    starts = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
    counted = lambda x, at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(x))).alias("c"), F.get(x, i).alias("num")))
    # Arrays of one place hold what is used several times, so that it is computed once.
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return F.slice(F.sort_array(once(nums, lambda x: once(starts(x), lambda at: counted(x, at)))), 1, n)["num"]


def frequency_tickets(numbers: DataFrame, cells: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """A ticket per cell: the `pick` most frequent numbers of the `window` draws before the target, from place run on.

    All targets share one pass over blocks of draws; a target's numbers are counted in its own row, from the arrays of the
    draws before it.
    """
    ranks = places(numbers.select("issue").distinct(), "issue")
    draws = as_arrays(numbers, "issue").join(ranks, "issue").select("issue", "place", "nums")
    framed = with_before(draws, window).where(F.size("before") > 0).join(targets.select("issue"), "issue", "left_semi")
    most = cells.agg(F.max(F.col("pick") + F.col("run"))).first()[0] or 0
    ranked = framed.select("issue", most_frequent(F.col("before")["nums"], most).alias("ranked"))
    own = cells.join(ranked, "issue").select("issue", "pick", "run", F.sort_array(F.slice("ranked", F.col("run") + 1, F.col("pick"))).alias("nums"))
    return own.where(F.size("nums") > 0)


def report(tickets: DataFrame, draws: DataFrame, stake: int = 2) -> DataFrame:
    """(pick, run, tickets, hits, prize, return_rate)."""
    scored = payout.score(tickets.select(F.col("run").alias("ticket_id"), "issue", "nums"), draws).withColumnRenamed("ticket_id", "run")
    out = scored.groupBy("pick", "run").agg(F.count("*").alias("tickets"), F.sum("hits").alias("hits"), F.sum("amount").cast("decimal(20,2)").alias("prize"))
    return out.select("pick", "run", "tickets", "hits", "prize", F.round(F.col("prize").cast("double") / (F.col("tickets") * stake) * 100, 4).alias("return_rate"))
