"""Checks of candidate tickets against a profile of the history: a chain of stages, the first that fails is the code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import odd_count, run_lengths
from ..sources.draws import as_arrays
from . import metrics


@dataclass(frozen=True)
class Profile:
    """Rates of the history; lists are indexed by overlap (0 to pick), decade (0 to 7) and run length (0 to 20)."""

    pick: int
    repeat: list[float]
    hot: float
    cold: float
    odd: float
    groups: list[float]
    runs: list[float]
    sums: dict[int, float]
    adjacency: float
    hot_numbers: list[int]
    cold_numbers: list[int]
    newest: list[int]
    second: list[int]


def profile(h: DataFrame, window: int, pick: int, sum_width: int = 50) -> Profile:
    """A handful of bounded aggregates of a bounded history (h holds 2 x window draws)."""
    near = h.where(F.col("rn") < window).cache()
    repeat = {r["overlap"]: r["draws"] for r in metrics.repeat_histogram(h, window, pick).collect()}
    total = max(sum(repeat.values()), 1)
    rate = metrics.hot_cold_rate(h, window).first()
    runs = {r["len"]: r["runs"] / r["draws"] for r in metrics.consecutive_runs(near).collect()}
    adjacency = metrics.adjacency(h, window).first()
    hot = metrics.hot_cold(near).collect()
    draws = {r["rn"]: list(r["nums"]) for r in as_arrays(h.where("rn < 2"), "rn").collect()}
    sums = {int(r["bin"].split("-")[0]): r["rate"] for r in metrics.sum_distribution(near, pick, sum_width).collect()}
    out = Profile(
        pick, [repeat.get(i, 0) / total for i in range(pick + 1)], (rate["hot_hits"] or 0) / max(rate["hits"] or 0, 1), (rate["cold_hits"] or 0) / max(rate["hits"] or 0, 1),
        metrics.parity(near).first()["odd_rate"], [r["rate"] for r in metrics.decade_groups(near).orderBy("bin").collect()], [runs.get(i, 0.0) for i in range(21)], sums,
        (adjacency["marched"] or 0) / max(adjacency["total"] or 0, 1), [r["num"] for r in hot if r["kind"] == "hot"], [r["num"] for r in hot if r["kind"] == "cold"], draws.get(0, []), draws.get(1, []),
    )
    near.unpersist()
    return out


def ints(x: list[int]) -> Column:
    return F.array(*[F.lit(i) for i in x]).cast("array<int>")


def measured(tickets: DataFrame, p: Profile, sum_width: int = 50) -> DataFrame:
    """tickets (ticket_id, nums ascending) with `sound` (size, no repeated number), `needs` and `sum_good`.

    needs: for each of the six stages the least threshold under which the ticket passes it, infinity if none does; so one
    measurement serves every threshold.
    """
    n, k = F.col("nums"), p.pick
    never = F.lit(float("inf"))
    shares = F.array(*[F.lit(float(x)) for x in p.repeat])
    overlap = F.size(F.array_intersect(n, ints(p.newest)))
    expected = F.element_at(shares, F.least(overlap, F.lit(k)) + 1)
    others = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i != overlap, F.element_at(shares, i + 1)).otherwise(0.0)))
    repeat = F.greatest(others, F.when(overlap >= 1, F.abs(expected - 1.0)).otherwise(0.0))
    size = F.greatest(F.size(n), F.lit(1))
    share = lambda own: F.size(F.array_intersect(n, ints(own))) / size
    hot = F.greatest(F.abs(share(p.hot_numbers) - p.hot), F.abs(share(p.cold_numbers) - p.cold))
    group_bad = F.lit(False)
    for g, his in enumerate(p.groups):
        now = F.size(F.filter(n, lambda x, g=g: F.floor((x - 1) / 10) == g)) / size
        if k >= 8:
            group_bad = group_bad | (now < 0.01) if his > 0.1 else group_bad | (now > 0.1) if his <= 0.01 else group_bad
        elif his < 0.01:
            group_bad = group_bad | (now > 0)
    lengths = run_lengths(n)
    seen = [i for i in range(2, k + 1) if p.runs[i] > 0]
    rare = [i for i in range(2, k + 1) if p.runs[i] <= 0.01]
    run_bad = F.exists(lengths, lambda x: x.isin(*rare)) if rare else F.lit(False)
    run_bad = run_bad | (~F.exists(lengths, lambda x: x.isin(*seen)) if seen else F.lit(True))
    total = F.aggregate(n, F.lit(0), lambda s, x: s + x)
    good_sums = [b for b, r in p.sums.items() if r >= 0.1]
    sum_good = (F.floor((total - 1) / sum_width) * sum_width + 1).isin(*good_sums) if good_sums else F.lit(False)
    old = ints(p.newest)
    marched = F.size(F.filter(n, lambda x: ~F.array_contains(old, x) & (F.array_contains(old, x - 1) | F.array_contains(old, x + 1)))) / size
    hard = lambda bad: F.when(bad, never).otherwise(0.0)
    needs = F.array(repeat, hot, F.abs(odd_count(n) / size - p.odd), hard(group_bad), hard(run_bad), F.abs(marched - p.adjacency))
    sound = (F.size(n) == k) & (F.size(F.array_distinct(n)) == F.size(n))
    return tickets.withColumns({"sound": sound, "needs": needs, "sum_good": sum_good})


def first_failure(sound: bool, needs: list[float], sum_good: bool, thresholds: list[float]) -> int:
    """The code of a measured ticket: 99 passes; -1 size, repeats or sum; 0 to 5 by stage."""
    if not sound:
        return -1
    for stage, (need, threshold) in enumerate(zip(needs, thresholds, strict=True)):
        if stage == 5 and not sum_good:
            return -1
        if need > threshold:
            return stage
    return 99


def validate(tickets: DataFrame, p: Profile, thresholds: tuple[float, ...], sum_width: int = 50) -> DataFrame:
    """tickets (ticket_id, nums ascending) with code: 99 passes; -1 size, repeats, duplicate or sum; 0 to 5 by stage."""
    again = F.row_number().over(Window.partitionBy("nums").orderBy("ticket_id")) > 1
    fails = lambda stage: F.get("needs", F.lit(stage)) > thresholds[stage]
    code = F.when(~F.col("sound") | again, -1)
    for stage in range(5):
        code = code.when(fails(stage), stage)
    code = code.when(~F.col("sum_good"), -1).when(fails(5), 5).otherwise(99)
    return measured(tickets, p, sum_width).withColumn("code", code).drop("sound", "needs", "sum_good")


def rank(validated: DataFrame, p: Profile, scores: DataFrame, information: DataFrame, weight: float = 1.0) -> DataFrame:
    """Passing tickets (all, if none passes) by score: parity gap, mean feature score and shared information of pairs."""
    n = F.col("nums")
    pairs = F.flatten(F.transform(n, lambda a: F.transform(F.filter(n, lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    mi = validated.select("ticket_id", F.explode(pairs).alias("q")).select("ticket_id", "q.i", "q.j").join(F.broadcast(information), ["i", "j"]).groupBy("ticket_id").agg(F.sum("mi").alias("mi"))
    feature = validated.select("ticket_id", F.explode("nums").alias("num")).join(F.broadcast(scores.select("num", "combined")), "num").groupBy("ticket_id").agg(F.avg("combined").alias("feature"))
    rows = validated.join(mi, "ticket_id", "left").join(feature, "ticket_id", "left").na.fill(0.0, ["mi", "feature"])
    value = F.col("feature") - 10 * F.abs(odd_count(n) / F.size(n) - p.odd) - weight * F.col("mi") / F.size(n)
    passed = (F.col("code") == 99).cast("int")
    return rows.select("ticket_id", "nums", "code", F.round(value, 6).alias("score"), passed.alias("passed")).orderBy(F.desc("passed"), F.desc("score"), "ticket_id")
