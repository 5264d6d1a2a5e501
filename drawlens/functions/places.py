"""Places of rows in an order over the whole table, as a prefix sum in two steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into: bounds what is broadcast and what one task adds up.
RANGES = 64


def places(rows: DataFrame, by: str, name: str = "place", descending: bool = False, first: int = 1, ranges: int = RANGES) -> DataFrame:
    """rows with their places in the order of `by`, counted from `first`.

    Approximate quantiles cut the order into ranges, every range numbers its own rows, and the sizes of the ranges before
    it (at most `ranges` + 1 numbers) are added. No task sees more than a range, and the range of a row depends on its value
    alone, so a task that is run again agrees with the others. `by` holds numbers or times without repetitions; one null may
    be among them and is the least.
    """
    cuts = rows.agg(F.percentile_approx(by, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(20 * ranges)).alias("at")).first()["at"]
    own = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts or []))]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_first(by)
    inside = rows.withColumn("_range", own).withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    sizes = inside.groupBy("_range").agg(F.max("_inside").alias("_size"))
    before = Window.orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_inside") + (first - 1)).drop("_range", "_inside", "_before")
