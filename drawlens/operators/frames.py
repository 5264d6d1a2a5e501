"""Frames of the draws before each draw, over whole histories: features, their components, and a model of what follows.

A frame needs its draw's neighbours only, so a history is cut into blocks of consecutive places, each with the last draws
of the block before it (a halo); windows run inside blocks.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import multi_hot, odd_count, overlap
from ..functions.places import places
from ..sources.draws import as_arrays

BINS = 8


def with_before(draws: DataFrame, width: int, block: int = 4096) -> DataFrame:
    """draws (place, ...) with `before`: an array of the (at most `width`) draws before each as structs, nearest first.

    Places are consecutive. A draw is in its own block and, near the end, in the next one's halo.
    """
    own = F.floor(F.col("place") / block)
    later = F.floor((F.col("place") + width) / block)
    dealt = draws.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, later)))
    inside = Window.partitionBy("_block").orderBy("place").rowsBetween(-width, -1)
    framed = dealt.withColumn("before", F.reverse(F.collect_list(F.struct(*draws.columns)).over(inside)))
    return framed.where(F.col("_block") == F.col("_own")).drop("_own", "_block")


def counted(before: Column, width: int, universe: int = 80) -> Column:
    """How often each number is in the nearest `width` draws of before."""
    zero = F.array_repeat(F.lit(0), universe)
    return F.aggregate(F.slice(before["hot"], 1, width), zero, lambda total, hot: F.zip_with(total, hot, lambda a, b: a + b))


def decades(nums: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda g: F.size(F.filter(nums, lambda n: F.floor((n - 1) / 10) == g)))


def frames(numbers: DataFrame, width: int = 10, window: int = 50, hottest: int = 10, block: int = 4096) -> DataFrame:
    """(issue, place, features, target) of every draw with `width` older ones.

    features: overlaps of consecutive draws of the frame, how often each number is in it, odd numbers of each draw, and the
    decades of each draw: 179 counts for ten draws, the draws nearest first. target: how many of the draw's numbers are
    among the `hottest` of the `window` draws (or all there are) before it, ties to the smaller number.
    """
    ranks = places(numbers.select("issue").distinct(), "issue", first=0)
    draws = as_arrays(numbers, "issue").join(ranks, "issue").select("issue", "place", "nums")
    draws = draws.withColumns({"hot": multi_hot(F.col("nums")), "odd": odd_count(F.col("nums")), "decades": decades(F.col("nums"))})
    own = with_before(draws, max(width, window), block).where(F.size("before") >= width)
    before = F.col("before")
    near = lambda name: F.slice(before[name], 1, width)
    overlaps = F.transform(F.sequence(F.lit(0), F.lit(width - 2)), lambda j: overlap(F.get(before["nums"], j), F.get(before["nums"], j + 1)))
    order = F.slice(F.array_sort(F.transform(counted(before, window), lambda c, i: F.struct((-c).alias("c"), (i + 1).alias("num")))), 1, hottest)
    return own.select(
        "issue", "place",
        F.concat(overlaps if width > 1 else F.array().cast("array<int>"), counted(before, width), near("odd"), F.flatten(near("decades"))).alias("features"),
        overlap(F.col("nums"), order["num"]).alias("target"),
    )


def components(framed: DataFrame, k: int = 20) -> tuple[DataFrame, list[float]]:
    """framed with `components`: the first k principal components of the standardised features; and the share of the
    variance that each explains.
    """
    vectors = framed.withColumn("vector", array_to_vector(F.col("features").cast("array<double>")))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="vector", outputCol="scaled").fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="scaled", outputCol="components").fit(scaled)
    return model.transform(scaled).drop("vector", "scaled"), model.explainedVariance.toArray().tolist()


def forecast(framed: DataFrame, k: int = 20, share: float = 0.8) -> DataFrame:
    """(issue, target, prediction) of the newest draws: a ridge regression on the components, fitted on the older `share`.

    Draws are independent, so this measures how little the past tells.
    """
    own, _ = components(framed, k)
    ends = own.agg(F.min("place").alias("a"), F.max("place").alias("b")).first()
    cut = ends["a"] + (ends["b"] - ends["a"] + 1) * share
    model = LinearRegression(featuresCol="components", labelCol="target", regParam=0.01, solver="normal").fit(own.where(F.col("place") < cut))
    return model.transform(own.where(F.col("place") >= cut)).select("issue", "target", F.round("prediction", 6).alias("prediction"))
