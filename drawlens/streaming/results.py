"""Result files as they arrive: each is scored once against its draw, by an incremental stream of the folder.

Files of tickets are CSV with columns b1, b2, ... and lie in folders pick=K/issue=I/run=R (what `write` makes); K is read
from the path, as is the issue. A file may also hold the tickets of a block of issues: it then lies in the folder of the
block's first and has their issues in a column after b1 to b10. A report row for each issue of a file is written by the load
that takes it; a load that is done again replaces its own rows, so a restart counts nothing twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PRIZES
from ..operators import payout

MOST = max(PRIZES)
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
REPORT = "file string, issue bigint, pick int, run string, modified timestamp, tickets bigint, prize decimal(20,2), stake bigint, return_rate double, known boolean, load bigint"


def write(tickets: DataFrame, path: str, run: str, pick: int, block: int = 1) -> None:
    """tickets (issue, nums of `pick` numbers) as CSV files, a folder for each block of issues (for each issue, if it is 1); a
    run written again replaces the blocks that it writes. Files cost more than rows, so long histories need long blocks.
    """
    named = [F.element_at("nums", i + 1).alias(f"b{i + 1}") for i in range(pick)]
    issue = F.col("issue")
    if block > 1:
        named += [F.lit(None).cast("int").alias(f"b{i + 1}") for i in range(pick, MOST)] + [issue.alias("own_issue")]
        issue = (issue - F.pmod(issue, F.lit(block))).alias("issue")
    rows = tickets.select(*named, F.lit(pick).alias("pick"), issue, F.lit(run).alias("run"))
    tasks = int(tickets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes would else come to one task
    rows.repartition(tasks, "issue").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("pick", "issue", "run").csv(path)


def stream(spark: SparkSession, path: str, files_per_load: int = 1000) -> DataFrame:
    """(file, issue, pick, run, modified, nums) of the tickets in files that arrive below path; only result folders count."""
    schema = ", ".join(f"b{i + 1} int" for i in range(MOST)) + ", own_issue bigint, pick int, issue bigint, run string"
    rows = spark.readStream.schema(schema).option("header", True).option("enforceSchema", True).option("maxFilesPerTrigger", files_per_load).csv(path)
    nums = F.sort_array(F.filter(F.array(*[f"b{i + 1}" for i in range(MOST)]), lambda x: x.isNotNull()))
    inside = F.regexp_extract("_metadata.file_path", r"(pick=[^/]*/issue=[^/]*/run=[^/]*/[^/]*)$", 1)
    issue = F.coalesce(F.when(F.col("pick") <= MOST, F.col("own_issue")), "issue")
    return rows.select(inside.alias("file"), issue.alias("issue"), "pick", "run", F.col("_metadata.file_modification_time").alias("modified"), nums.alias("nums")).where("file <> ''")


def score(tickets: DataFrame, draws: DataFrame, stake: int = 2) -> DataFrame:
    """A row for each issue of a file: tickets, prize, stake, return rate; without a prize and known false until its draw is known."""
    met = tickets.join(draws.select("issue", F.col("nums").alias("drawn")), "issue", "left")
    own = [F.size("nums").alias("own_pick"), F.size(F.array_intersect("nums", "drawn")).alias("hits"), F.col("drawn").isNotNull().alias("known")]
    amounts = F.broadcast(payout.prizes(tickets.sparkSession).toDF("own_pick", "hits", "amount"))
    paid = met.select("file", "issue", "pick", "run", "modified", *own).join(amounts, ["own_pick", "hits"], "left")
    # Rows lie by issue after the join, so those of a file are added up where they are.
    prize = F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(20,2)")
    rows = paid.groupBy("file", "issue", "pick", "run", "modified").agg(F.count("*").alias("tickets"), prize.alias("prize"), F.bool_or("known").alias("known"))
    staked = rows.withColumn("stake", F.col("tickets") * stake)
    rate = F.round(F.col("prize").cast("double") / F.col("stake") * 100, 4)
    return staked.select("file", "issue", "pick", "run", "modified", "tickets", "prize", "stake", rate.alias("return_rate"), "known")


def take(spark: SparkSession, path: str, draws: DataFrame, output: str, checkpoint: str, stake: int = 2, files_per_load: int = 1000) -> None:
    """Scores all files that are new and stops. The draws are kept until then; files are listed by as many tasks as there are
    cores, not by one for each.
    """
    kept, before = draws.select("issue", "nums").persist(), spark.conf.get(LISTING)

    def load(batch: DataFrame, number: int) -> None:
        rows = score(batch, kept, stake).coalesce(spark.sparkContext.defaultParallelism).withColumn("load", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(output)

    try:
        spark.conf.set(LISTING, str(spark.sparkContext.defaultParallelism))
        stream(spark, path, files_per_load).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(LISTING, before)
        kept.unpersist()


def report(spark: SparkSession, output: str, least: float | None = None) -> DataFrame:
    """The newest row of every file; `least` leaves those at or above a return rate."""
    try:
        rows = spark.read.schema(REPORT).parquet(output)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], REPORT)
    own = rows.withColumn("newest", F.max("load").over(Window.partitionBy("file"))).where(F.col("load") == F.col("newest")).drop("newest", "load")
    return own if least is None else own.where(F.col("return_rate") >= least)


def latest(reported: DataFrame) -> DataFrame:
    """One row: the file written last (ties to the greater name), its newest issue and pick."""
    return reported.agg(F.max_by(F.struct("file", "issue", "pick"), F.struct("modified", "file", "issue")).alias("x")).select("x.*")
