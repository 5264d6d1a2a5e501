"""Features of single draws and of windows of draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import consecutive_pairs, even_count, odd_count, prime_count
from ..sources.draws import as_arrays


def row_features(h: DataFrame) -> DataFrame:
    """(issue, ...): parity, high and low, primes, consecutive pairs, mean gap and moments of each draw."""
    moments = h.groupBy("issue").agg(F.max("num").alias("max_num"), F.min("num").alias("min_num"), F.avg("num").alias("m"), F.expr("median(num)").alias("med"), F.stddev_pop("num").alias("sd"), F.skewness("num").alias("sk"), F.kurtosis("num").alias("ku"))
    n = F.col("nums")
    high = F.size(F.filter(n, lambda x: x > 40))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    clean = lambda c: F.round(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), 6)
    composite = F.size(F.filter(n, lambda x: x > 1)) - prime_count(n)
    rows = as_arrays(h, "issue").join(moments, "issue")
    return rows.select(
        "issue", odd_count(n).alias("odd"), even_count(n).alias("even"), ratio(odd_count(n), even_count(n)).alias("odd_even"), ratio(high, F.size(n) - high).alias("high_low"),
        ratio(prime_count(n), prime_count(n) + composite).alias("prime_share"), consecutive_pairs(n).alias("consecutive"), ratio(F.element_at(n, -1) - F.element_at(n, 1), F.size(n) - 1).alias("mean_gap"),
        "max_num", "min_num", F.round("m", 6).alias("mean_num"), F.round("med", 6).alias("median_num"), F.round("sd", 6).alias("std_num"), clean(F.col("sk")).alias("skew_num"), clean(F.col("ku")).alias("kurt_num"),
    )


def window_features(h: DataFrame, width: int = 3) -> DataFrame:
    """(rn, flat): the numbers of each draw and the `width` older ones, one after another; full windows only."""
    starts = F.explode(F.sequence(F.col("rn") - width, F.col("rn"))).alias("start")
    own = as_arrays(h, "rn").select(starts, "rn", "nums").where("start >= 0").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("rn", "nums"))).alias("w"))
    return own.where(F.size("w") == width + 1).select(F.col("start").alias("rn"), F.flatten("w.nums").alias("flat"))
