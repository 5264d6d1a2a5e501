"""Scores of the numbers: recency, momentum, Dirichlet, centrality, principal components, embeddings, and their blend."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.columns import dot, norm
from ..sources.draws import as_arrays, grid, universe
from .pairs import cooccurrence, pair_rows


def scaled(x: str, phantom: bool = False) -> Column:
    """Minimum to 0, maximum to 1; with phantom a constant 0 takes part; all 0 where they are equal."""
    every = Window.partitionBy()  # over the 80 numbers
    low, high = F.min(x).over(every), F.max(x).over(every)
    if phantom:
        low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    return F.when(high - low < 1e-9, 0.0).otherwise((F.col(x) - low) / (high - low))


def recency_momentum(h: DataFrame, recent: int = 40, reference: int = 160) -> DataFrame:
    """(num, recency, momentum)."""
    n = h.agg(F.countDistinct("rn").alias("n")).select(F.least("n", F.lit(recent)).alias("nr"), F.least("n", F.lit(reference)).alias("nf"))
    rows = h.join(F.broadcast(n))
    rec = F.sum(F.when(F.col("rn") < recent, F.greatest(1 - F.col("rn") / F.col("nr"), F.lit(0.1))).otherwise(0.0))
    ref = F.sum((F.col("rn") < reference).cast("int"))
    per = rows.groupBy("num").agg(rec.alias("rec"), (rec - ref * F.first(F.col("nr") / F.col("nf"))).alias("mom"))
    per = universe(h.sparkSession).join(per, "num", "left").na.fill(0.0, ["rec", "mom"])
    return per.select("num", F.round(scaled("rec", True), 6).alias("recency"), F.round(scaled("mom", True), 6).alias("momentum"))


def dirichlet_scores(h: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(num, dirichlet, mean): posterior mean less its deviation; a slot 0 with the least prior takes part."""
    counts = h.groupBy("num").agg(F.count("*").alias("g"), F.sum((F.col("rn") < config.dirichlet_window).cast("int")).alias("l"))
    slots = universe(h.sparkSession).unionByName(h.sparkSession.range(1).select(F.lit(0).alias("num")))
    every = Window.partitionBy()
    a = slots.join(counts, "num", "left").na.fill(0, ["g", "l"]).withColumn("a", F.greatest(F.coalesce(F.try_divide(F.col("g"), F.sum("g").over(every)), F.lit(1.0 / (config.dirichlet_prior * 80))) * config.dirichlet_prior * 80, F.lit(1e-6)) + F.col("l"))
    a = a.withColumn("s", F.sum("a").over(every))
    variance = F.col("a") * (F.col("s") - F.col("a")) / (F.col("s") * F.col("s") * (F.col("s") + 1))
    a = a.withColumn("x", F.col("a") / F.col("s") - config.dirichlet_variance_weight * F.sqrt(variance))
    return a.select("num", F.round(scaled("x"), 6).alias("dirichlet"), F.round(F.col("a") / F.col("s"), 8).alias("mean")).where("num > 0")


def principal(cells: DataFrame, squarings: int = 12, top: int = 80) -> DataFrame:
    """(num, x): the unit principal eigenvector of a symmetric matrix given by its cells (i, j, x), i <= j; absent ones are 0.

    Power iteration of 2^squarings steps from a fixed vector: the matrix, of top x top numbers whatever the history, stands
    in one row, and array functions square it. Its largest entry is positive; a matrix of zeros gives zeros.
    """
    numbers = F.sequence(F.lit(1), F.lit(top))
    both = cells.unionByName(cells.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "x"))
    full = universe(cells.sparkSession, top).select(F.col("num").alias("i"), F.explode(numbers).alias("j")).join(both, ["i", "j"], "left").na.fill(0.0, ["x"])
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda s: s[value])
    matrix = full.groupBy("i").agg(in_order("j", "x").alias("line")).agg(in_order("i", "line").alias("m"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y)

    def squared(m: Column, _: Column) -> Column:
        size = F.array(F.nullif(total(F.transform(m, lambda r: dot(r, r))), F.lit(0.0)))  # one place, so that it is computed once
        return F.get(F.transform(size, lambda f: F.transform(m, lambda r: F.transform(m, lambda q: dot(r, q) / f))), F.lit(0))

    start = F.transform(numbers, lambda i: (i * 37 % top + 1) / F.lit(float(top)))
    power = matrix.select(F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), F.col("m"), squared).alias("m"))
    x = power.select(F.posexplode(F.transform("m", lambda r: dot(r, start))).alias("pos", "x")).select((F.col("pos") + 1).alias("num"), F.coalesce("x", F.lit(0.0)).alias("x"))
    every = Window.partitionBy()  # over the numbers
    length = F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x")).over(every)), F.lit(0.0))
    return x.select("num", F.coalesce(F.signum(F.max_by("x", F.abs("x")).over(every)) * F.col("x") / length, F.lit(0.0)).alias("x"))


def cooccurrence_centrality(h: DataFrame, decay: float = 0.97) -> DataFrame:
    """(num, cooc): the principal eigenvector of the decayed pair matrix, scaled."""
    own = principal(cooccurrence(h, decay).select("i", "j", F.col("weight").alias("x"))).withColumn("x", F.abs("x"))
    return own.select("num", F.round(scaled("x"), 6).alias("cooc"))


def covariances(h: DataFrame, top: int = 80) -> DataFrame:
    """(i, j, x), i <= j: the covariance of the numbers' being drawn, times the square of the draws; whole numbers."""
    spark = h.sparkSession
    n = h.agg(F.countDistinct("rn").alias("n"))
    counts = universe(spark, top).join(h.groupBy("num").agg(F.count("*").alias("c")), "num", "left").na.fill(0, ["c"])
    joint = pair_rows(h).groupBy("i", "j").agg(F.count("*").alias("joint"))
    cells = universe(spark, top).select(F.col("num").alias("i"), F.explode(F.sequence("num", F.lit(top))).alias("j"))
    rows = cells.join(counts.toDF("i", "ci"), "i").join(counts.toDF("j", "cj"), "j").join(joint, ["i", "j"], "left").join(F.broadcast(n))
    together = F.when(F.col("i") == F.col("j"), F.col("ci")).otherwise(F.coalesce("joint", F.lit(0)))
    return rows.select("i", "j", (F.col("n") * together - F.col("ci") * F.col("cj")).cast("double").alias("x"))


def pca_loadings(h: DataFrame, limit: int, components: int = 1) -> DataFrame:
    """(num, pca): loadings of the first principal components of the indicator matrix, the largest one positive, scaled; of
    several components the sum of their absolute loadings.
    """
    if components == 1:
        return principal(covariances(h.where(F.col("rn") < limit))).select("num", F.round(scaled("x"), 6).alias("pca"))
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = grid(h, limit).groupBy("rn").agg(F.transform(F.sort_array(F.collect_list(F.struct("num", "hit"))), lambda s: s["hit"].cast("double")).alias("v"))
    pc = PCA(k=components, inputCol="x", outputCol="y").fit(rows.select(array_to_vector("v").alias("x"))).pc.toArray()
    loadings = h.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(np.abs(pc).sum(1))], "num int, x double")
    return loadings.select("num", F.round(scaled("x"), 6).alias("pca"))


def embedding_scores(vectors: DataFrame, mode: str = "norm", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, graph): norms, or cosines with the mean vector, scaled to 0..1."""
    v = F.col(vector)
    if mode == "norm":
        rows = vectors.select(key, norm(v).alias("x"))
    else:
        flat = vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
        mean = flat.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
        rows = vectors.join(F.broadcast(mean)).select(key, F.coalesce(dot(v, F.col("mean")) / F.nullif(norm(v) * norm(F.col("mean")), F.lit(0.0)), F.lit(0.0)).alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rows.join(F.broadcast(ends)).select(key, F.round(F.when(F.col("hi") - F.col("lo") < 1e-9, 0.0).otherwise((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 5).alias("graph"))


def enhanced_scores(h: DataFrame, limit: int, config: EngineConfig = DEFAULT, graph: DataFrame | None = None, graph_weight: float = 0.15) -> DataFrame:
    """(num, every channel, combined, place): the weighted blend, ranked with ties by number."""
    out = recency_momentum(h, config.recent, config.recent * 4)
    for part in (cooccurrence_centrality(h, config.decay), dirichlet_scores(h, config).select("num", "dirichlet"), pca_loadings(h, limit)):
        out = out.join(F.broadcast(part), "num")
    weights = dict(config.weights)
    if graph is not None:
        out = out.join(F.broadcast(graph), "num", "left").na.fill(0.0, ["graph"])
        weights["graph"] = graph_weight
    blend = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    combined = F.round(blend.cast("decimal(20,8)"), 6).cast("double")  # channels have six places, weights two
    return out.withColumn("combined", combined).withColumn("place", F.row_number().over(Window.orderBy(F.desc("combined"), "num")))


def draw_clusters(h: DataFrame, limit: int, k: int = 3, seed: int = 1) -> DataFrame:
    """(rn, cluster): K-means of the indicator vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.columns import multi_hot

    rows = as_arrays(h.where(F.col("rn") < limit), "rn").select("rn", array_to_vector(F.transform(multi_hot(F.col("nums")), lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("rn", F.col("prediction").alias("cluster"))
