"""How many trailing windows are looked at, draw by draw: longer ones come in where draws differ much from their past, and
go again where they differ little.

The windows are a list of which the first are always used; a level tells how many of the others are. A draw moves the level
up, down or not at all, between none and all. A run of such moves is one as well: add something, then keep to two bounds.
Moves therefore compose, in blocks of places side by side and over the blocks, and no task walks through a whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import with_before

#: Windows, how many of them are always used, the means that move the level, and the draws these are over.
WINDOWS, ALWAYS, GROW, SHRINK, MEMORY = (3, 5, 7, 9, 11, 13, 15), 4, 0.04, 0.015, 20


def moves(differences: DataFrame, grow: float = GROW, shrink: float = SHRINK, memory: int = MEMORY, block: int = 4096) -> DataFrame:
    """(place, move): 1, -1 or 0 by the mean of the last `memory` differences, 0 with fewer than half of them."""
    own = with_before(differences.select("place", "difference"), memory - 1, block)
    seen = F.concat(F.array("difference"), F.col("before")["difference"])
    mean = F.round(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen), 10)
    move = F.when(F.size(seen) < max(4, memory // 2), 0).when(mean > grow, 1).when(mean < shrink, -1).otherwise(0)
    return own.select("place", move.cast("int").alias("move"))


def _then(run: Column, move: Column, top: int) -> Column:
    """A run of moves (add, low, high) and one more."""
    kept = lambda x: F.greatest(F.least(x, F.lit(top)), F.lit(0))
    return F.struct((run["add"] + move).alias("add"), kept(run["low"] + move).alias("low"), kept(run["high"] + move).alias("high"))


def levels(moved: DataFrame, top: int, block: int = 1024) -> DataFrame:
    """(place, level) after every move, from level 0; places are consecutive."""
    number = lambda x: F.lit(x).cast("int")
    still = F.struct(number(0).alias("add"), number(0).alias("low"), number(top).alias("high"))
    blocks = moved.groupBy(F.floor(F.col("place") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "move"))).alias("own"))
    runs = blocks.withColumn("run", F.aggregate(F.col("own")["move"], still, lambda run, m: _then(run, m, top)))
    apply = lambda level, run: F.greatest(F.least(level + run["add"], run["high"]), run["low"])
    earlier = F.collect_list("run").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("block", F.aggregate(earlier, number(0), apply).alias("level"))  # a row for each block
    begun = runs.select("block", "own").join(F.broadcast(starts), "block")
    walk = F.aggregate("own", F.array("level"), lambda seen, x: F.concat(seen, F.array(F.greatest(F.least(F.element_at(seen, -1) + x["move"], number(top)), number(0)))))
    steps = F.arrays_zip(F.col("own")["place"].alias("place"), F.slice(walk, 2, block).alias("level"))
    return begun.select(F.explode(steps).alias("x")).select("x.place", "x.level")


def adapted(differences: DataFrame, windows: tuple[int, ...] = WINDOWS, always: int = ALWAYS, grow: float = GROW, shrink: float = SHRINK, memory: int = MEMORY, block: int = 1024) -> DataFrame:
    """(place, windows) after every draw of differences (place, difference)."""
    own = levels(moves(differences, grow, shrink, memory, 4 * block), len(windows) - always, block)
    return own.select("place", F.slice(F.array(*[F.lit(w) for w in windows]), F.lit(1), F.col("level") + always).alias("windows"))
