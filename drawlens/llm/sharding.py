"""Sharding: minimax contiguous partition of atomic groups, in DataFrame operations only.

Rows of equal text are one atomic group. Groups are ordered by their text's SHA-256, an order that spreads any input
evenly, and the smallest capacity is searched for which cutting greedily along that order needs no more shards than
asked. The search is binary and runs over a summary: running totals in buckets, some ten thousands in all, each with its
least and its greatest group end. Where a cut falls within a bucket, its place is known to that bucket only, and a
capacity is feasible, infeasible or undecided; a further job then cuts finer buckets, but only where cuts can still fall.
Two or three jobs settle any total, and the driver never sees groups.

Running totals come from block totals and windows inside blocks, as many as the rows need; rows of one id and text are
counted first, slots come from running counts by text and by the hash of the id, so neither a group that holds a third of
all rows nor a row that occurs very often is handled by one task.

A null text has no bytes and the CRC of the empty text; null texts are a group of their own. Repeated rows are members
of their group like any other. An empty table gives an empty result; texts may be of any length. With few groups shards
may stay empty. Only the two columns named are read, so others can't clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, named

BLOCK, BLOCKS = 50_000, 256  # rows of a window, and windows at least
BUCKETS = 1 << 16  # of a summary, at least; 32 times the square of the shards, as every cut adds to what is undecided
MEMBERS = 1 << 20  # rows of a text that one window numbers, copies of a row that one array lists


def _running(rows: DataFrame, order: list[str], what: str, blocks: int) -> DataFrame:
    """Adds before_<what>: its total over all rows earlier in the order, which begins with the digest."""
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("block", F.shiftright(place * blocks, 32).cast("int"))
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("block").agg(F.sum(what).alias("total"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over `blocks` rows at most
    offset = totals.select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("at"))
    out = rows.join(F.broadcast(offset), "block")
    return out.withColumn(f"before_{what}", F.col("at") + F.coalesce(F.sum(what).over(inside), F.lit(0))).drop("block", "at")


class Summary:
    """What is known of the group ends: of each bucket (from, to], its least and greatest end, in order."""

    def __init__(self, buckets: list[tuple[int, int]]):
        self.least, self.most = [a for a, _ in buckets], [b for _, b in buckets]

    def last(self, limit: int) -> tuple[int, int]:
        """Bounds of the greatest end that is no greater than limit (0 if there is none)."""
        i = bisect_right(self.least, limit) - 1
        if i < 0:
            return 0, 0
        return (self.most[i], self.most[i]) if self.most[i] <= limit else (self.least[i], limit)

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the running totals at which the shards end; the greedy cut does not fall as the one before rises."""
        out, low, high = [], 0, 0
        for _ in range(shards):
            low, high = self.last(low + capacity)[0], self.last(high + capacity)[1]
            out.append((low, high))
        return out


def capacity(ends: DataFrame, shards: int, least: int = BUCKETS) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the running totals at which the shards end.

    ends: `end`, the running total after each group, and `size` of the group.
    """
    row = ends.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    total, largest = int(row["total"] or 0), int(row["largest"] or 0)
    low, high = max(-(-total // shards), largest), max(-(-total // shards), largest) + largest  # the latter surely does
    spans, buckets = [(0, total)], max(least, 32 * shards * shards)  # where cuts may fall: (from, to]
    while True:
        width = max(1, -(-sum(b - a for a, b in spans) // buckets))
        number, first = F.lit(None), 0
        for a, b in spans:
            number = F.when((F.col("end") > a) & (F.col("end") <= b), first + F.floor((F.col("end") - a - 1) / width)).otherwise(number)
            first += -(-(b - a) // width)
        found = ends.withColumn("bucket", number).where("bucket is not null").groupBy("bucket").agg(F.min("end").alias("least"), F.max("end").alias("most")).orderBy("bucket").collect()
        summary = Summary([(r["least"], r["most"]) for r in found])
        infeasible, feasible = low - 1, high
        while feasible - infeasible > 1:  # the smallest that surely does
            middle = (infeasible + feasible) // 2
            infeasible, feasible = (infeasible, middle) if summary.cuts(middle, shards)[-1][0] >= total else (middle, feasible)
        high, below = feasible, low - 1
        while infeasible - below > 0:  # the greatest that surely does not
            middle = (below + infeasible + 1) // 2
            below, infeasible = (middle, infeasible) if summary.cuts(middle, shards)[-1][1] < total else (below, middle - 1)
        low = below + 1
        cuts = summary.cuts(high, shards)
        if low == high and all(a == b for a, b in cuts):
            return high, [a for a, _ in cuts]
        # Cuts of any capacity left lie between the least of the lowest and the most of the highest.
        spans, reach = [], 0
        for (a, _), (_, b) in zip(summary.cuts(low, shards), cuts, strict=True):
            a, b = max(a - 1, reach, 0), max(b, reach)
            if b > a:
                spans, reach = [*spans, (a, b)], b


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null); slots in order of the text's SHA-256, the
    id's MD5 and the id.
    """
    data = F.coalesce(named(text), F.lit("")).cast("binary")
    digest = F.when(named(text).isNull(), F.sha2(F.lit("\0null").cast("binary"), 256)).otherwise(F.sha2(data, 256))
    rows = docs.select(named(doc_id).alias("id"), (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("crc"), digest.alias("digest"))
    rows = rows.groupBy("id", "size", "crc", "digest").agg(F.count("*").alias("n"))
    rows = materialise(rows.withColumn("spread", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))), "shard-rows")
    total = rows.count()
    digits, blocks = 2, max(BLOCKS, total // BLOCK)
    while 16**digits * MEMBERS < total:
        digits += 1
    rows = rows.withColumn("salt", F.substring("spread", 1, digits))
    parts = materialise(rows.groupBy("digest", "salt").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")), "shard-parts")
    groups = parts.groupBy("digest").agg(F.sum("size").alias("size"))
    ends = materialise(_running(groups, ["digest"], "size", blocks).select("digest", "size", (F.col("before_size") + F.col("size")).alias("end")), "shard-ends")
    number = F.lit(0)
    for cut in capacity(ends, shards)[1][:-1]:
        number = number + (F.col("end") > cut).cast("int")
    placed = _running(parts.join(ends.select("digest", number.cast("int").alias("shard")), "digest"), ["digest", "salt"], "n", blocks)
    first = placed.groupBy("shard").agg(F.min("before_n").alias("first"))
    placed = materialise(placed.join(F.broadcast(first), "shard").select("digest", "salt", "shard", (F.col("before_n") - F.col("first")).alias("base")), "shard-places")
    discard(parts, ends)
    own = Window.partitionBy("digest", "salt").orderBy("spread", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(placed, ["digest", "salt"]).withColumn("slot", F.col("base") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    # A row that occurs several times takes as many slots.
    out = out.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(MEMBERS).cast("bigint"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + MEMBERS, F.col("n")) - 1)))
    return out.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
