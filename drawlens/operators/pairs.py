"""Pairs and itemsets of numbers that are drawn together: co-occurrence, mutual information, association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.draws import as_arrays


def pair_rows(h: DataFrame) -> DataFrame:
    """(rn, i, j), i < j: one row a pair of a draw, made from the draw's own array without a shuffle for the join."""
    nums = F.col("nums")
    pairs = F.flatten(F.transform(nums, lambda a: F.transform(F.filter(nums, lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    return as_arrays(h, "rn").select("rn", F.explode(pairs).alias("p")).select("rn", "p.i", "p.j")


def cooccurrence(h: DataFrame, decay: float = 0.97) -> DataFrame:
    return pair_rows(h).groupBy("i", "j").agg(F.count("*").alias("joint"), F.round(F.sum(F.pow(F.lit(decay), F.col("rn"))), 6).alias("weight"))


def top_pairs(h: DataFrame, n: int = 20) -> DataFrame:
    return pair_rows(h).groupBy("i", "j").agg(F.count("*").alias("joint")).orderBy(F.desc("joint"), "i", "j").limit(n)


def pair_universe(spark) -> DataFrame:
    return spark.range(1, 81).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(80))).alias("j")).where("i < j")


def mutual_information(h: DataFrame, e: float = 1e-6) -> DataFrame:
    """(i, j, mi) of all 3,160 pairs in natural units, smoothed by e."""
    spark = h.sparkSession
    counts = h.groupBy("num").agg(F.count("*").alias("c"))
    n = h.agg(F.countDistinct("rn").alias("n"))
    joint = pair_rows(h).groupBy("i", "j").agg(F.count("*").alias("jc"))
    rows = pair_universe(spark).join(F.broadcast(counts.withColumnsRenamed({"num": "i", "c": "ci"})), "i", "left").join(F.broadcast(counts.withColumnsRenamed({"num": "j", "c": "cj"})), "j", "left").join(joint, ["i", "j"], "left").join(F.broadcast(n))
    clip = lambda x: F.least(F.greatest(x, F.lit(e)), F.lit(1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.select("i", "j", clip((zero("ci") + e) / (F.col("n") + 2 * e)).alias("pi"), clip((zero("cj") + e) / (F.col("n") + 2 * e)).alias("pj"), clip((zero("jc") + e) / (F.col("n") + 4 * e)).alias("p11"))
    rows = rows.withColumns({"p10": clip(F.col("pi") - F.col("p11")), "p01": clip(F.col("pj") - F.col("p11"))})
    rows = rows.withColumns({"p00": clip(1 - F.col("p11") - F.col("p10") - F.col("p01")), "qi": clip(1 - F.col("pi")), "qj": clip(1 - F.col("pj"))})
    term = lambda p, a, b: F.col(p) * F.log(F.col(p) / F.greatest(F.col(a) * F.col(b), F.lit(e)))
    total = term("p11", "pi", "pj") + term("p10", "pi", "qj") + term("p01", "qi", "pj") + term("p00", "qi", "qj")
    return rows.select("i", "j", F.round(F.greatest(total, F.lit(0.0)), 8).alias("mi"))


def pointwise_information(h: DataFrame, limit: int) -> DataFrame:
    """(i, j, term): p_ij log2(p_ij / (p_i p_j)) of the pairs drawn together."""
    counts = F.broadcast(h.groupBy("num").agg((F.count("*") / limit).alias("p")))
    joint = pair_rows(h).groupBy("i", "j").agg((F.count("*") / limit).alias("pij"))
    rows = joint.join(counts.withColumnsRenamed({"num": "i", "p": "pi"}), "i").join(counts.withColumnsRenamed({"num": "j", "p": "pj"}), "j")
    return rows.select("i", "j", (F.round(F.col("pij") * F.log2(F.col("pij") / (F.col("pi") * F.col("pj"))), 6) + 0.0).alias("term"))


WORDS = 64  # words of 64 draws in a row of a bitmap
BROADCAST_SIZE = 3  # of sets that may be broadcast: there are 82,160 of three numbers


def bitmaps(h: DataFrame) -> DataFrame:
    """(num, chunk, bits): for each number and chunk of draws an array of words with a bit for each draw that has it."""
    bit = F.expr("shiftleft(1L, cast(pmod(rn, 64) as int))")
    word = F.pmod(F.floor(F.col("rn") / 64), F.lit(WORDS))
    words = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("bigint")) for i in range(WORDS)]
    return h.groupBy("num", F.floor(F.col("rn") / (64 * WORDS)).alias("chunk")).agg(F.array(*words).alias("bits"))


def itemsets(h: DataFrame, most: int = 2, support: float = 0.0) -> DataFrame:
    """(items array, freq): the itemsets of up to `most` numbers in at least `support` of the draws, with their frequencies.

    Level by level, from bitmaps: a set of k grows by a larger number to the draws that both have, chunk by chunk, and goes on
    only if it is frequent. Nothing lists the subsets of a draw. Bitmaps stay where their chunk is: only counts travel, and the
    sets found frequent (their number depends on the universe, not on the history) come back to them.
    """
    n = F.broadcast(h.agg(F.countDistinct("rn").alias("n")))
    draws_of = lambda bits: F.aggregate(bits, F.lit(0).cast("bigint"), lambda total, w: total + F.bit_count(w))

    def frequent(rows: DataFrame) -> DataFrame:
        counted = rows.select("items", draws_of(F.col("bits")).alias("own")).where("own > 0").groupBy("items").agg(F.sum("own").alias("freq"))
        return counted.join(n).where(F.col("freq") / F.col("n") >= support).select("items", "freq")

    # As many tasks as there are cores: bitmaps are few bytes and much work, and would else be put together.
    single = bitmaps(h).repartition(h.sparkSession.sparkContext.defaultParallelism, "chunk")
    rows = single.select(F.array("num").alias("items"), "chunk", "bits")
    out = found = frequent(rows)
    more = single.select("num", "chunk", F.col("bits").alias("added")).join(F.broadcast(found.select(F.element_at("items", 1).alias("num"))), "num", "left_semi")
    for size in range(2, most + 1):
        kept = found.select("items")
        level = rows.join(F.broadcast(kept) if size <= BROADCAST_SIZE + 1 else kept, "items", "left_semi")
        grown = level.join(more, "chunk").where(F.col("num") > F.element_at("items", -1))
        rows = grown.select(F.concat("items", F.array("num")).alias("items"), "chunk", F.zip_with("bits", "added", lambda a, b: a.bitwiseAND(b)).alias("bits"))
        found = frequent(rows)
        out = out.unionByName(found)
    return out


def association_rules(h: DataFrame, support: float = 0.08, confidence: float = 0.3, most: int = 2) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift) with a single consequent, from itemsets of up to `most`."""
    sets = itemsets(h, most, support)
    n = h.agg(F.countDistinct("rn").alias("n"))
    frequent = sets.where(F.size("items") >= 2).join(F.broadcast(n))
    whole = frequent.select("items", "freq", "n", F.explode("items").alias("consequent")).withColumn("antecedent", F.array_except("items", F.array("consequent")))
    left = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("fa"))
    right = sets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("consequent"), F.col("freq").alias("fc"))
    rules = whole.join(left, "antecedent").join(F.broadcast(right), "consequent")
    conf = F.col("freq") / F.col("fa")
    return rules.where(conf >= confidence).select("antecedent", "consequent", F.round(F.col("freq") / F.col("n"), 6).alias("support"), F.round(conf, 6).alias("confidence"), F.round(conf / (F.col("fc") / F.col("n")), 6).alias("lift"))


def violations(tickets: DataFrame, rules: DataFrame) -> DataFrame:
    """(ticket_id, antecedent, consequent, confidence) of every rule that a ticket violates: its antecedent is held and its
    consequent isn't.

    Rules are looked up by the first number of their antecedent, so a ticket meets only rules it can violate.
    """
    keyed = rules.select(F.element_at(F.sort_array("antecedent"), 1).alias("first"), "antecedent", "consequent", "confidence")
    met = tickets.select("ticket_id", "nums", F.explode("nums").alias("first")).join(keyed, "first")
    broken = (F.size(F.array_except("antecedent", "nums")) == 0) & ~F.array_contains(F.col("nums"), F.col("consequent"))
    return met.where(broken).select("ticket_id", "antecedent", "consequent", "confidence")


def filter_tickets(tickets: DataFrame, rules: DataFrame, mode: str = "soft", weight: float = 0.1) -> DataFrame:
    """(ticket_id, nums, violated, penalty, accepted): how many rules each ticket violates and what follows."""
    per = violations(tickets, rules).groupBy("ticket_id").agg(F.count("*").alias("violated"), F.max("confidence").alias("worst"))
    out = tickets.join(per, "ticket_id", "left").withColumn("violated", F.coalesce("violated", F.lit(0)))
    if mode == "hard":
        return out.select("ticket_id", "nums", "violated", F.lit(0.0).alias("penalty"), (F.col("violated") == 0).alias("accepted"))
    return out.select("ticket_id", "nums", "violated", F.round(F.coalesce(F.col("worst") * weight, F.lit(0.0)), 6).alias("penalty"), F.lit(True).alias("accepted"))
