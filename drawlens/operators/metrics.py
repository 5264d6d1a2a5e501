"""Statistics of a history (rn, issue, num): frequencies, parity, groups, runs, overlaps, sums, Markov chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import subset_sums
from ..sources.draws import as_arrays, grid, universe


def whole(column: str) -> Column:
    """The total over all rows (80 at most), null instead of 0: shares of nothing are null."""
    total = F.sum(column).over(Window.partitionBy())
    return F.when(total != 0, total)


def top_numbers(numbers: DataFrame, n: int = 10) -> DataFrame:
    return numbers.groupBy("num").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "num").limit(n)


def frequencies(h: DataFrame) -> DataFrame:
    """(num, cnt) of all 80 numbers."""
    counts = h.groupBy("num").agg(F.count("*").alias("cnt"))
    return universe(h.sparkSession).join(counts, "num", "left").select("num", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def hot_cold(h: DataFrame, edge: int = 10) -> DataFrame:
    """(num, rate, place, kind): the `edge` most and least frequent numbers; ties by number."""
    rate = F.round(F.col("cnt").cast("double") / whole("cnt"), 5)
    ranked = frequencies(h).withColumn("rate", rate).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "num")))
    kind = F.when(F.col("place") <= edge, "hot").when(F.col("place") > 80 - edge, "cold")
    return ranked.withColumn("kind", kind).where("kind is not null and rate is not null").select("num", "rate", "place", "kind")


def hot_cold_rate(h: DataFrame, window: int, shift: int = 1, edge: int = 10) -> DataFrame:
    """hot_hits, cold_hits, hits: how many numbers of the draws below `window` were hot or cold in the window after."""
    frame = Window.partitionBy("num").orderBy("rn").rowsBetween(shift, window - 1)
    cells = grid(h, 2 * window).withColumn("f", F.sum("hit").over(frame)).where("f is not null")
    ranked = cells.withColumn("place", F.row_number().over(Window.partitionBy("rn").orderBy(F.desc("f"), "num"))).where(F.col("rn") < window)
    return ranked.agg(F.sum(F.when(F.col("place") <= edge, F.col("hit")).otherwise(0)).alias("hot_hits"), F.sum(F.when(F.col("place") > 80 - edge, F.col("hit")).otherwise(0)).alias("cold_hits"), F.sum("hit").alias("hits"))


def parity(h: DataFrame) -> DataFrame:
    odd = F.coalesce(F.avg((F.col("num") % 2).cast("double")), F.lit(0.0))
    return h.agg(odd.alias("o"), F.count("*").alias("n")).select(F.round("o", 6).alias("odd_rate"), F.round(F.when(F.col("n") > 0, 1 - F.col("o")).otherwise(0.0), 6).alias("even_rate"))


def decade_groups(h: DataFrame) -> DataFrame:
    bins = universe(h.sparkSession, 8).select((F.col("num") - 1).alias("bin"))
    counts = h.groupBy(F.floor((F.col("num") - 1) / 10).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    total = whole("c")
    return bins.join(counts, "bin", "left").select("bin", F.round(F.coalesce(F.col("c") / total, F.lit(0.0)), 6).alias("rate"))


def bayes_posterior(h: DataFrame) -> DataFrame:
    """(num, posterior, place): (1 + c) / (2 + draws)."""
    draws = h.agg(F.countDistinct("rn").alias("n"))
    scored = frequencies(h).join(F.broadcast(draws)).select("num", F.round((F.col("cnt") + 1.0) / (F.col("n") + 2.0), 6).alias("posterior"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("posterior"), "num")))


def consecutive_runs(h: DataFrame) -> DataFrame:
    """(len, runs, draws): maximal runs by length, and the draws that have any."""
    island = F.col("num") - F.row_number().over(Window.partitionBy("rn").orderBy("num"))
    runs = h.select("rn", "num", island.alias("g")).groupBy("rn", "g").agg(F.count("*").alias("len")).where("len > 1")
    per = runs.groupBy("len").agg(F.count("*").alias("runs"))
    return per.join(F.broadcast(runs.agg(F.countDistinct("rn").alias("draws")))).select("len", "runs", "draws")


def shifted_pairs(h: DataFrame, limit: int, shift: int) -> DataFrame:
    """(rn, nums, other): each draw below limit and the one `shift` places older (null beyond the end)."""
    arrays = as_arrays(h, "rn")
    return arrays.where(F.col("rn") < limit).join(arrays.select((F.col("rn") - shift).alias("rn"), F.col("nums").alias("other")), "rn", "left")


def adjacency(h: DataFrame, limit: int, shift: int = 1) -> DataFrame:
    """(marched, total): numbers that do not repeat but neighbour a number of the older draw."""
    pairs = shifted_pairs(h, limit, shift).withColumn("other", F.coalesce("other", F.array().cast("array<int>")))
    near = F.size(F.filter("nums", lambda x: ~F.array_contains(F.col("other"), x) & (F.array_contains(F.col("other"), x - 1) | F.array_contains(F.col("other"), x + 1))))
    return pairs.agg(F.sum(near).cast("bigint").alias("marched"), F.sum(F.size("nums")).cast("bigint").alias("total"))


def repeat_histogram(h: DataFrame, limit: int, pick: int = 10, shift: int = 1) -> DataFrame:
    """(overlap, draws): overlaps with the older draw, scaled to tickets of `pick` and rounded half to even."""
    pairs = shifted_pairs(h, limit, shift)
    common = F.coalesce(F.size(F.array_intersect("nums", "other")), F.lit(0))
    scaled = F.bround(F.when(F.size("nums") > pick, common * pick / 20.0).otherwise(common.cast("double")), 0).cast("int")
    return pairs.select(scaled.alias("overlap")).where(F.col("overlap") <= pick).groupBy("overlap").agg(F.count("*").alias("draws"))


def sum_distribution(h: DataFrame, k: int, width: int = 50) -> DataFrame:
    """(bin, subsets, rate): sums of all k-subsets of every draw in bins, counted without listing them."""
    counts = as_arrays(h, "rn").select(F.posexplode(subset_sums(F.col("nums"), k)).alias("s", "n")).where("n > 0")
    binned = counts.groupBy(F.floor((F.col("s") - 1) / width).cast("int").alias("g")).agg(F.sum("n").alias("subsets"))
    return binned.select(F.concat_ws("-", (F.col("g") * width + 1).cast("string"), ((F.col("g") + 1) * width).cast("string")).alias("bin"), "subsets", F.round(F.col("subsets") / whole("subsets"), 6).alias("rate"))


def prime_rate(h: DataFrame) -> DataFrame:
    """(primes, draws): draws by how many primes they hold."""
    from ..functions.columns import PRIMES

    return h.groupBy("rn").agg(F.sum(F.col("num").isin(*PRIMES).cast("int")).alias("primes")).groupBy("primes").agg(F.count("*").alias("draws"))


def entropy(h: DataFrame) -> DataFrame:
    share = frequencies(h).withColumn("p", F.col("cnt") / whole("cnt"))
    return share.agg(F.round(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)), 6).alias("entropy"))


def chi_square(h: DataFrame) -> DataFrame:
    """Goodness of fit of the frequencies to equal ones: statistic and degrees of freedom."""
    counts = frequencies(h).withColumn("e", F.avg("cnt").over(Window.partitionBy())).where("e > 0")
    return counts.agg(F.round(F.sum((F.col("cnt") - F.col("e")) ** 2 / F.col("e")), 6).alias("statistic"), (F.count("*") - 1).alias("dof"))


def chi_square_tail(statistic: float, dof: int) -> float:
    """Chance that a chi-square variable exceeds the statistic: the finite sums for even and for odd degrees of freedom."""
    half = statistic / 2
    if half <= 0 or dof <= 0:
        return 1.0
    first = 0.0 if dof % 2 == 0 else 0.5
    terms = (math.exp((k + first) * math.log(half) - half - math.lgamma(k + first + 1)) for k in range(dof // 2))
    return min(1.0, sum(terms) + (math.erfc(math.sqrt(half)) if dof % 2 else 0.0))


def chi_square_test(h: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(statistic, dof, p_value, significant); one row reaches the driver. Without draws nothing is significant."""
    row = chi_square(h).first()
    statistic, dof = row["statistic"] or 0.0, max(row["dof"], 0)
    p = chi_square_tail(statistic, dof)
    return h.sparkSession.createDataFrame([(statistic, dof, round(p, 6), p < alpha)], "statistic double, dof bigint, p_value double, significant boolean")


def markov_transitions(h: DataFrame, order: int = 1) -> DataFrame:
    """(state, num, n, p): numbers that follow each state (the sets of the `order` draws before, oldest first)."""
    arrays = as_arrays(h, "rn")
    text = arrays.select("rn", F.concat_ws(",", F.col("nums").cast("array<string>")).alias("s"))
    keyed = arrays
    for k in range(1, order + 1):  # joins by rank, not a window: no task gets all draws
        keyed = keyed.join(text.select((F.col("rn") - k).alias("rn"), F.col("s").alias(f"s{k}")), "rn")
    keyed = keyed.select("nums", F.concat_ws("|", *[F.col(f"s{k}") for k in range(order, 0, -1)]).alias("state"))
    counts = keyed.select("state", F.explode("nums").alias("num")).groupBy("state", "num").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("state")), 6))


def window_divergence(h: DataFrame, windows: tuple[int, ...] = (3, 5, 7, 9)) -> DataFrame:
    """(win, parity_diff, group_diff): the newest draw against trailing windows; means of the positive differences."""
    wins = F.explode(F.array(*[F.lit(w) for w in windows])).alias("win")
    past = h.where(F.col("rn") >= 1).select("rn", "num", wins).where(F.col("rn") <= F.col("win"))
    now = h.where("rn = 0")
    share = lambda x: F.avg(x.cast("double"))
    flags = {"parity": [(F.col("num") % 2 == 1), (F.col("num") % 2 == 0)], "group": [F.floor((F.col("num") - 1) / 10) == g for g in range(8)]}
    columns = {f"{k}{i}": c for k, own in flags.items() for i, c in enumerate(own)}
    old = past.groupBy("win").agg(*[share(c).alias(f"o_{k}") for k, c in columns.items()])
    new = now.agg(*[share(c).alias(f"n_{k}") for k, c in columns.items()])
    both = old.join(F.broadcast(new))
    out = both.select("win", *[F.array(*[F.abs(F.col(f"o_{k}{i}") - F.col(f"n_{k}{i}")) for i in range(len(own))]).alias(k) for k, own in flags.items()])
    mean = lambda c: F.round(F.coalesce(F.aggregate(F.filter(c, lambda x: x > 1e-12), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(F.filter(c, lambda x: x > 1e-12)), F.lit(0)), F.lit(0.0)), 5)
    return out.select("win", mean("parity").alias("parity_diff"), mean("group").alias("group_diff"))


BASE = (0.05, 0.05, 0.05, 0.05, 0.01, 0.05)
METRICS = ("repeat", "ball", "parity", "group", "consecutive", "march")


def _rates(draws: list[list[int]], at: int, n: int, hot_window: int, pick: int, edge: int = 10) -> list[list[float]]:
    """The six metrics of the n draws from place `at` on, newest first, each against the draws before it."""
    repeat, balls, groups, runs = [0.0] * (pick + 1), [0, 0], [0] * 8, [0] * 81
    odd = marched = size = with_runs = 0
    for i in range(at, at + n):
        own, older = set(draws[i]), set(draws[i + 1]) if i + 1 < len(draws) else set()
        size += len(own)
        overlap = round(len(own & older) * pick / 20)
        if overlap <= pick:
            repeat[overlap] += 1 / n
        counts = [0] * 81
        for d in draws[i + 1 : i + hot_window]:
            for x in d:
                counts[x] += 1
        ranked = sorted(range(1, 81), key=lambda x: (-counts[x], x))
        balls = [balls[0] + len(own & set(ranked[:edge])), balls[1] + len(own & set(ranked[-edge:]))]
        odd += sum(x % 2 for x in own)
        marched += sum(x not in older and (x - 1 in older or x + 1 in older) for x in own)
        found = False
        for x in own:
            groups[(x - 1) // 10] += 1
            if x - 1 not in own:
                length = next(k for k in range(1, 81) if x + k not in own)
                runs[length] += length > 1
                found |= length > 1
        with_runs += found
    return [repeat[1:], [b / size for b in balls], [odd / size, 1 - odd / size], [g / size for g in groups], [r / max(with_runs, 1) for r in runs[2 : pick + 1]], [marched / size]]


def rate_divergence(h: DataFrame, pick: int = 10, windows: tuple[int, ...] = (3, 5, 7, 9), hot_window: int = 50, base: tuple[float, ...] = BASE) -> DataFrame:
    """(win, six *_diff): the newest draw against trailing windows, means of the positive differences; their mean and
    maximum over the windows (avg, max); and the results of the modes: mode0 is avg, mode1 at least `base`, mode2 that of max.

    h is a bounded history, of hot_window draws and the longest window's; it comes to the driver.
    """
    rows = {r["rn"]: r["nums"] for r in as_arrays(h.where(F.col("rn") < max(hot_window, 2 * max(windows) + 2)), "rn").collect()}
    draws = [list(rows[i]) for i in sorted(rows)]
    schema = "win string, " + ", ".join(f"{m}_diff double" for m in METRICS)
    windows = tuple(w for w in windows if w < len(draws))
    if not windows:
        return h.sparkSession.createDataFrame([], schema)
    now, out = _rates(draws, 0, 1, hot_window, pick), []
    for win in windows:
        gaps = [[g for a, b in zip(x, y, strict=True) if (g := abs(a - b)) > 1e-12] for x, y in zip(now, _rates(draws, 1, win, win - 1, pick), strict=True)]
        out.append([sum(g) / len(g) if g else 0.0 for g in gaps])
    mean = [round(sum(x) / len(out), 5) for x in zip(*out, strict=True)]
    most = [round(max(x), 5) for x in zip(*out, strict=True)]
    table = [(str(w), *(round(x, 5) for x in own)) for w, own in zip(windows, out, strict=True)] + [("avg", *mean), ("max", *most), ("mode0", *mean)]
    table += [(name, *(max(float(x), float(b)) for x, b in zip(own, base, strict=True))) for name, own in (("mode1", mean), ("mode2", most))]
    return h.sparkSession.createDataFrame([(w, *map(float, own)) for w, *own in table], schema)
