"""Candidate tickets: random, by hot and cold quotas, greedy, Markov, genetic and copula sampling.

Every row draws from a generator seeded by its own id, so results do not depend on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.draws import as_arrays
from .constraints import Profile, first_failure, measured
from .pairs import filter_tickets

TICKET = "ticket_id bigint, nums array<int>"


def random_tickets(spark: SparkSession, rows: int, pick: int, seed: int = 42) -> DataFrame:
    """Uniform tickets: the `pick` numbers of least hash for each id; no Python."""
    ranked = F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda n: F.struct(F.xxhash64(F.lit(seed), F.col("id"), n).alias("h"), n.alias("n"))))
    return spark.range(rows).select(F.col("id").alias("ticket_id"), F.sort_array(F.transform(F.slice(ranked, 1, pick), lambda s: s["n"])).cast("array<int>").alias("nums"))


def _sampled(spark: SparkSession, rows: int, make, seed: int, first: int = 0) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"ticket_id": frame["id"], "nums": [sorted(int(x) for x in make(np.random.default_rng([seed, i]))) for i in frame["id"]]})

    return spark.range(first, first + rows).mapInPandas(run, TICKET)


def heuristic_tickets(spark: SparkSession, p: Profile, rows: int, parity_slack: float = 0.1, seed: int = 42, first: int = 0) -> DataFrame:
    """Quotas of hot, cold and odd numbers from the profile, the rest from the other numbers."""
    k, hot, cold = p.pick, p.hot_numbers, p.cold_numbers

    def make(r: np.random.Generator):
        own = list(r.choice(hot, min(max(1, round(p.hot * k)), len(hot)), replace=False)) + list(r.choice(cold, min(max(1, round(p.cold * k)), len(cold)), replace=False))
        own = own[:k]
        odd = int(r.integers(round(max(p.odd - parity_slack, 0) * k), round(min(p.odd + parity_slack, 1) * k) + 1)) - sum(x % 2 for x in own)
        rest = [x for x in range(1, 81) if x not in hot and x not in cold]
        odds, evens = [x for x in rest if x % 2], [x for x in rest if x % 2 == 0]
        need = k - len(own)
        n_odd = min(max(odd, 0), need, len(odds))
        return [*own, *r.choice(odds, n_odd, replace=False), *r.choice(evens, need - n_odd, replace=False)]

    return _sampled(spark, rows, make, seed, first)


def relaxed(threshold: float, target: float, epoch: int) -> float:
    """One step of a threshold towards its target, clipped to 0.01 .. 0.2."""
    return float(np.clip(threshold + max(0.05 * 0.98**epoch, 0.005) * 0.2 * (target - threshold), 0.01, 0.2))


def loosened(threshold: float) -> float:
    """One step of a threshold outwards: a hundredth or a tenth of it, whichever is more."""
    return threshold + max(0.01, 0.1 * threshold)


@dataclass(frozen=True)
class Patience:
    """failures: of one stage after which its threshold gives way; a fifth of them are enough to ignore earlier stages.
    attempts: proposals for one ticket, after which a ticket that need not pass takes its place.
    """

    failures: int = 50
    attempts: int = 1000


@dataclass
class Relaxation:
    """Takes proposals one after another and accepts those that pass; thresholds give way stage by stage.

    A stage whose failures exceed `patience.failures` is relaxed by `step`; the later ones then start again from their first
    thresholds. Counts begin anew with each accepted ticket, relaxed thresholds stay.
    """

    start: list[float]
    patience: Patience = Patience()
    step: Callable[[float], float] = loosened

    def __post_init__(self):
        self.thresholds = list(self.start)
        self._begin()

    def _begin(self) -> None:
        self.failures, self.deepest, self.attempts = [0] * len(self.start), -1, 0

    def offer(self, sound: bool, needs: list[float], sum_good: bool) -> bool:
        self.attempts += 1
        code = first_failure(sound, needs, sum_good, self.thresholds)
        if 0 <= code < 99 and code >= self.deepest:
            self.failures[code] += 1
            if self.failures[code] > self.patience.failures // 5:
                self.deepest = code
            if self.failures[code] > self.patience.failures:
                self.thresholds[code] = self.step(self.thresholds[code])
                self.failures[code] = 0
                for later in range(code + 1, len(self.start)):
                    self.thresholds[later], self.failures[later] = self.start[later], 0
        return code == 99

    def accept(self) -> list[float]:
        """The thresholds of the ticket that ends here; the next one begins."""
        self._begin()
        return list(self.thresholds)


@dataclass(frozen=True)
class Found:
    nums: tuple[int, ...]
    thresholds: list[float]
    passed: bool


def accepted(spark: SparkSession, p: Profile, total: int, thresholds: list[float], batch: int = 2000, patience: Patience = Patience(), rules: DataFrame | None = None, mode: str = "soft", seed: int = 42) -> list[Found]:
    """Rejection sampling with relaxation: `total` distinct tickets in the order in which a plain loop over the proposals
    finds them, each with the thresholds in force (and its rule penalty added to them).

    Spark proposes and measures `batch` tickets at a time, all stages at once; so what the loop does with a proposal needs no
    second look at it, however thresholds change in between. The driver holds one batch of measurements, a parameter. With
    `rules`, a ticket that hard rules reject is passed over. A ticket that isn't found in patience.attempts is uniform.
    """
    state, found, done = Relaxation(list(thresholds), patience), {}, 0
    while len(found) < total:
        rows = measured(heuristic_tickets(spark, p, batch, seed=seed, first=done), p)
        if rules is not None:
            rows = rows.join(filter_tickets(rows.select("ticket_id", "nums"), rules, mode).select("ticket_id", "penalty", "accepted"), "ticket_id")
        else:
            rows = rows.withColumns({"penalty": F.lit(0.0), "accepted": F.lit(True)})
        for r in rows.orderBy("ticket_id").collect():
            nums = tuple(r["nums"])
            if nums not in found and state.offer(r["sound"], r["needs"], r["sum_good"]) and r["accepted"]:
                found[nums] = Found(nums, [t + r["penalty"] for t in state.accept()], True)
            elif state.attempts >= patience.attempts:
                left = (tuple(x["nums"]) for x in random_tickets(spark, len(found) + 1, p.pick, seed + len(found)).collect())
                nums = next(x for x in left if x not in found)
                found[nums] = Found(nums, state.accept(), False)
            if len(found) == total:
                break
        done += batch
    return list(found.values())


def generate(spark: SparkSession, p: Profile, total: int, thresholds: list[float], batch: int = 2000, patience: Patience = Patience(), seed: int = 42) -> DataFrame:
    """(ticket_id, nums, passed): `total` distinct tickets; passed tells those that the stages let through from the uniform
    ones that took the place of others.
    """
    own = accepted(spark, p, total, thresholds, batch, patience, seed=seed)
    return spark.createDataFrame([(i, list(f.nums), f.passed) for i, f in enumerate(own)], TICKET + ", passed boolean")


def greedy_ticket(posterior: DataFrame, pick: int) -> list[int]:
    """From the 2 x pick likeliest numbers, in order, those that keep parity and decades in balance; then the rest."""
    top = [r["num"] for r in posterior.orderBy("place").limit(2 * pick).collect()]
    own: list[int] = []
    for strict in (True, False):
        for x in top:
            if len(own) == pick:
                break
            same = sum(y % 2 == x % 2 for y in own)
            decade = sum((y - 1) // 10 == (x - 1) // 10 for y in own)
            if x not in own and (not strict or same < -(-pick // 2) and decade < max(2, pick // 4)):
                own.append(x)
    return sorted(own)


def markov_tickets(spark: SparkSession, chances: dict[int, float], rows: int, pick: int, seed: int = 42) -> DataFrame:
    """Samples without replacement by the chances of the current state; evenly where none is known."""
    p = np.array([chances.get(i, 0.0) for i in range(1, 81)])
    p = p if (p > 0).sum() >= pick else np.ones(80)
    p = p / p.sum()
    return _sampled(spark, rows, lambda r: r.choice(np.arange(1, 81), pick, replace=False, p=p), seed)


def genetic_tickets(spark: SparkSession, p: Profile, islands: int = 4, size: int = 40, generations: int = 20, mutation: float = 0.1, best: int = 10, seed: int = 42) -> DataFrame:
    """(island, nums, fitness): islands evolve apart (elite of a quarter, tournaments of three, union crossover)."""

    def fitness(own: np.ndarray) -> float:
        hot, cold = np.isin(own, p.hot_numbers).mean(), np.isin(own, p.cold_numbers).mean()
        groups = np.bincount((own - 1) // 10, minlength=8) / len(own)
        overlap = np.isin(own, p.newest).sum()
        repeat = sum(abs(x - (i == overlap)) for i, x in enumerate(p.repeat) if i)
        return -(repeat + abs(hot - p.hot) + abs(cold - p.cold) + 2 * abs((own % 2).mean() - p.odd) + np.abs(groups - p.groups).sum())

    def evolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for island in frame["id"]:
                r = np.random.default_rng([seed, island])
                group = [np.sort(r.choice(np.arange(1, 81), p.pick, replace=False)) for _ in range(size)]
                for _ in range(generations):
                    group.sort(key=fitness, reverse=True)
                    half, new = group[: size // 2], group[: size // 4]
                    while len(new) < size:
                        a, b = (max((half[i] for i in r.integers(0, len(half), 3)), key=fitness) for _ in range(2))
                        child = r.choice(np.union1d(a, b), p.pick, replace=False)
                        if r.random() < mutation:
                            child[r.integers(0, p.pick)] = r.choice(np.setdiff1d(np.arange(1, 81), child))
                        new.append(np.sort(child))
                    group = new
                top = sorted({tuple(x.tolist()) for x in group}, key=lambda x: -fitness(np.array(x)))[:best]
                yield pd.DataFrame({"island": island, "nums": [list(x) for x in top], "fitness": [float(fitness(np.array(x))) for x in top]})

    return spark.range(islands).mapInPandas(evolve, "island bigint, nums array<int>, fitness double").orderBy(F.desc("fitness"), "island", "nums").limit(best)


def copula_factors(h: DataFrame, min_draws: int = 180, shrink: float = 0.1) -> tuple[np.ndarray, np.ndarray, dict]:
    """Log marginals, Cholesky factor of the shrunk correlation, and diagnostics; moments are aggregated (3,240 cells)."""
    from .pairs import pair_rows

    n = h.select("rn").distinct().count()
    if n < min_draws:
        raise ValueError(f"{n} draws; the copula needs {min_draws}")
    joint = np.zeros((80, 80))
    for r in h.groupBy("num").count().collect():
        joint[r["num"] - 1, r["num"] - 1] = r["count"]
    for r in pair_rows(h).groupBy("i", "j").count().collect():
        joint[r["i"] - 1, r["j"] - 1] = joint[r["j"] - 1, r["i"] - 1] = r["count"]
    marginal = np.clip(np.diag(joint) / n, 1e-4, 1 - 1e-4)
    covariance = (joint - n * np.outer(np.diag(joint) / n, np.diag(joint) / n)) / (n - 1)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    correlation = (1 - shrink) * covariance / np.outer(deviation, deviation) + shrink * np.eye(80)
    values, vectors = np.linalg.eigh((correlation + correlation.T) / 2)
    fixed = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    factor = np.linalg.cholesky(fixed + 1e-4 * np.eye(80) * (values.min() < 1e-6))
    return np.log(marginal), factor, {"effective_draws": n, "shrinkage": shrink, "marginal_min": float(marginal.min()), "marginal_max": float(marginal.max()), "condition_number": float(np.linalg.cond(fixed))}


def copula_tickets(h: DataFrame, desired: int, multiplier: float = 1.5, topk: int = 20, min_draws: int = 180, seed: int = 42) -> DataFrame:
    """Gaussian copula samples: correlated scores plus log marginals, the `topk` largest of each."""
    logs, factor, _ = copula_factors(h, min_draws)
    make = lambda r: np.argsort(-(factor @ r.standard_normal(80) + logs), kind="stable")[:topk] + 1
    return _sampled(h.sparkSession, int(np.ceil(desired * multiplier)), make, seed)


def newest(h: DataFrame) -> list[int]:
    return list(as_arrays(h.where("rn = 0"), "rn").first()["nums"])
