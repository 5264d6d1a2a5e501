"""Draws: reading them from files, deriving them from the star schema, and the canonical forms.

numbers: (issue bigint, num int); history: (rn int, issue, num), rn 0 the newest draw; draws: (issue, nums array<int>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.places import places

#: A history of at most this many draws may be held as rows of its own (20 of some 16 bytes a draw).
RECENT_MOST = 200_000


#: Numbers are remainders of 80 plus 1, so -78 to 80; a bucket's own are bits of three words, bit 0 stands for null.
OFFSET, WORDS, BITS = 79, 3, 64


def sets(lineitem: DataFrame) -> DataFrame:
    """(issue, w0, w1, w2): the numbers of each bucket of ten orders as bits, buckets of fewer than 20 left out; lines
    leave their task as three words a bucket.
    """
    issue = F.floor(F.col("l_orderkey") / 10).cast("bigint") + 2020000
    lines = lineitem.select(issue.alias("issue"), F.coalesce((F.col("l_partkey") % 80 + 1).cast("int") + OFFSET, F.lit(0)).alias("at"))
    bit = F.expr(f"shiftleft(1L, cast(at % {BITS} as int))")
    own = [F.coalesce(F.bit_or(F.when((F.col("at") >= w * BITS) & (F.col("at") < (w + 1) * BITS), bit)), F.lit(0).cast("bigint")).alias(f"w{w}") for w in range(WORDS)]
    return lines.groupBy("issue").agg(*own).where(sum((F.bit_count(f"w{w}") for w in range(WORDS)), F.lit(0)) >= 20)


def placed(buckets: DataFrame, multiplier: int = 37, size: int = 20) -> DataFrame:
    """buckets (issue, w0, w1, w2, ...) with `placed`: the first `size` numbers of each in an order of their own."""
    held = [F.expr(f"filter(sequence({w * BITS}, {w * BITS + BITS - 1}), i -> getbit(w{w}, i - {w * BITS}) = 1)") for w in range(WORDS)]
    order = lambda num: (num * multiplier + (F.col("issue") - 2020000) * 11) % 83
    num = lambda i: F.when(i > 0, i - OFFSET)
    own = F.slice(F.sort_array(F.transform(F.concat(*held), lambda i: F.struct(order(num(i)).alias("key"), num(i).alias("num")))), 1, size)
    return buckets.withColumn("placed", own).drop(*[f"w{w}" for w in range(WORDS)])


def ranked(lineitem: DataFrame, multiplier: int = 37, size: int = 20) -> DataFrame:
    """(issue, num, rk): `size` distinct numbers by bucket of ten orders, in an order of their own (deterministic).

    Rows are grouped by issue.
    """
    buckets = placed(sets(lineitem), multiplier, size)
    return buckets.select("issue", F.posexplode("placed").alias("rk", "x")).select("issue", "x.num", (F.col("rk") + 1).alias("rk"))


def derived(lineitem: DataFrame, multiplier: int = 37, size: int = 20) -> DataFrame:
    """numbers derived from order lines: draws of 20 distinct numbers by bucket of ten orders."""
    return ranked(lineitem, multiplier, size).drop("rk")


def placed_arrays(buckets: DataFrame, multiplier: int = 37, size: int = 20) -> DataFrame:
    """as_arrays(derived(lineitem, multiplier, size)) of sets(lineitem), without a row for each number."""
    nums = F.sort_array(F.filter("placed.num", lambda n: n.isNotNull()))
    return placed(buckets, multiplier, size).select("issue", nums.alias("nums"))


def draw_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def tickets(spark: SparkSession, sf_dir: str, pick: int = 10) -> DataFrame:
    """(issue, num) of one derived ticket of `pick` numbers per draw."""
    return derived(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 41, pick)


def _newest(draws: DataFrame, limit: int, before: int | None) -> DataFrame:
    """The newest `limit` of draws (issue, ...; a row each) with their rn, by a top-k that each partition cuts first."""
    if not 0 < limit <= RECENT_MOST:
        raise ValueError(f"limit must be 1 to {RECENT_MOST}")
    seen = draws.where(F.col("issue").isNotNull() if before is None else F.col("issue") < before)
    top = seen.orderBy(F.desc("issue")).limit(limit)
    return top.withColumn("rn", (F.row_number().over(Window.orderBy(F.desc("issue"))) - 1).cast("int"))


def _held(h: DataFrame) -> DataFrame:
    """A bounded history as rows of its own: whoever reads it, and however often, reads nothing of what it came from."""
    return h.sparkSession.createDataFrame(h.select("rn", "issue", "num").toArrow())


def recent(numbers: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """history of the newest `limit` draws (those older than issue `before`, if given), found at once in one pass."""
    draws = numbers.groupBy("issue").agg(F.collect_list(F.struct("num")).alias("own"))
    return _held(_newest(draws, limit, before).select("rn", "issue", F.explode("own.num").alias("num")))


def recent_derived(lineitem: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """recent(derived(lineitem), limit, before), whose numbers are looked at only in the draws that are left."""
    return _held(placed(_newest(sets(lineitem), limit, before)).select("rn", "issue", F.explode("placed.num").alias("num")))


def history(numbers: DataFrame) -> DataFrame:
    """history of all draws: the distinct issues are placed, newest first, and joined back."""
    ranks = places(numbers.select("issue").distinct(), "issue", "rn", descending=True, first=0)
    return numbers.join(ranks, "issue").select(F.col("rn").cast("int").alias("rn"), "issue", "num")


def split_by_issue(numbers: DataFrame, begin: int) -> DataFrame:
    """numbers with their part: train up to the issue `begin`, test after it."""
    return numbers.withColumn("part", F.when(F.col("issue") <= begin, "train").otherwise("test"))


def as_arrays(numbers: DataFrame, *keys: str) -> DataFrame:
    """One row per draw with ascending nums."""
    keys = keys or ("issue",)
    return numbers.groupBy(*keys).agg(F.sort_array(F.collect_list("num")).alias("nums"))


def universe(spark: SparkSession, top: int = 80) -> DataFrame:
    return spark.range(1, top + 1).select(F.col("id").cast("int").alias("num"))


def grid(h: DataFrame, limit: int, top: int = 80) -> DataFrame:
    """(rn, num, hit) for every rn below limit that occurs and every number."""
    cells = h.where(F.col("rn") < limit).select("rn").distinct().select("rn", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("num"))
    return cells.join(h.select("rn", "num", F.lit(1).alias("hit")), ["rn", "num"], "left").select("rn", "num", F.coalesce("hit", F.lit(0)).alias("hit"))
