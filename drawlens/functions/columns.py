"""Column functions for sets of numbers: all built-in expressions, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The primes up to 80.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79)


def valid(nums: Column, universe: int = 80) -> Column:
    return F.filter(nums, lambda x: x.between(1, universe))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def odd_count(nums: Column) -> Column:
    return F.size(F.filter(nums, lambda x: x % 2 == 1))


def even_count(nums: Column) -> Column:
    return F.size(F.filter(nums, lambda x: x % 2 == 0))


def prime_count(nums: Column) -> Column:
    return F.size(F.filter(nums, lambda x: x.isin(*PRIMES)))


def multi_hot(nums: Column, universe: int = 80) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(universe)), lambda n: F.array_contains(nums, n).cast("int"))


def decode_multi_hot(bits: Column, threshold: float = 0.25) -> Column:
    """Numbers whose score exceeds the threshold."""
    return F.filter(F.transform(bits, lambda x, i: F.when(x > threshold, i + 1)), lambda x: x.isNotNull())


def one_hot(num: Column, universe: int = 80) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(universe)), lambda n: (n == num).cast("int"))


def decode_one_hot(bits: Column) -> Column:
    """The number of the largest entry, the first of several; null for an empty array."""
    return F.nullif(F.array_position(bits, F.array_max(bits)).cast("int"), F.lit(0))


def consecutive_pairs(nums: Column) -> Column:
    """Neighbours in the list that differ by one."""
    return F.size(F.filter(F.zip_with(F.slice(nums, 2, F.greatest(F.size(nums) - 1, F.lit(0))), nums, lambda b, a: b - a), lambda d: d == 1))


def run_lengths(nums: Column) -> Column:
    """Lengths of maximal runs of consecutive numbers, runs of one left out; nums ascend."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("last"), F.lit(0).alias("len"))
    step = lambda s, x: F.when(x == s["last"] + 1, F.struct(s["done"].alias("done"), x.alias("last"), (s["len"] + 1).alias("len"))).otherwise(F.struct(F.when(s["len"] > 1, F.concat(s["done"], F.array(s["len"]))).otherwise(s["done"]).alias("done"), x.alias("last"), F.lit(1).alias("len")))
    return F.aggregate(nums, start, step, lambda s: F.when(s["len"] > 1, F.concat(s["done"], F.array(s["len"]))).otherwise(s["done"]))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def subset_sums(nums: Column, k: int, universe: int = 80) -> Column:
    """counts[s]: how many subsets of k of nums have the sum s, up to the sum of the k largest numbers of the universe.

    Counting, not enumeration: one pass over nums.
    """
    top = k * (2 * universe + 1 - k) // 2
    zero = F.array_repeat(F.lit(0).cast("bigint"), top + 1)
    start = F.concat(F.array(F.concat(F.array(F.lit(1).cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), top))), F.array_repeat(zero, k))
    shifted = lambda row, x: F.slice(F.concat(F.array_repeat(F.lit(0).cast("bigint"), x), row), 1, top + 1)
    step = lambda dp, x: F.transform(dp, lambda row, j: F.when(j == 0, row).otherwise(F.zip_with(row, shifted(F.element_at(dp, F.greatest(j, F.lit(1))), x), lambda a, b: a + b)))
    return F.aggregate(nums, start, step, lambda dp: F.element_at(dp, k + 1))
