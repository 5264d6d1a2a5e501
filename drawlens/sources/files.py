"""Readers and writers: CSV layouts by column name, ball-order text, HTML tables, result and threshold files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import places

#: Column names of the history files.
ISSUE, NUMBER, DATE = "期数", "红球_", "日期"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(issue, num, pos) of a history CSV in any of its layouts; columns are found by name."""
    rows = spark.read.option("header", True).csv(path)
    if ISSUE not in rows.columns:
        raise ValueError(f"{path} has no column {ISSUE}")
    numbers = sorted((c for c in rows.columns if c.startswith(NUMBER)), key=lambda c: int(c.removeprefix(NUMBER)))
    flat = rows.select(F.col(ISSUE).cast("bigint").alias("issue"), F.posexplode(F.array(*[F.col(c).cast("int") for c in numbers])).alias("pos", "num"))
    return flat.where("issue is not null and num between 1 and 80").select("issue", "num", "pos")


def parse_sequence(lines: DataFrame, value: str = "value", size: int = 20) -> DataFrame:
    """(issue, nums in ball order) of text lines `issue n1 ... n20,rest`; shorter lines are left out."""
    tokens = F.split(F.trim(F.split(F.col(value), ",").getItem(0)), r"\s+")
    issue = F.get(tokens, F.lit(0))
    good = (F.size(tokens) >= size + 1) & issue.rlike(r"^\d+$")
    return lines.where(good).select(issue.try_cast("bigint").alias("issue"), F.transform(F.slice(tokens, 2, size), lambda x: x.try_cast("int")).alias("nums"))


def parse_tables(pages: DataFrame, html: str = "html", size: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(issue, nums, keep...) of the rows of HTML tables: a first cell of digits, then at least `size` number cells."""
    rows = pages.select(*keep, F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row"))
    cells = rows.select(*keep, F.filter(F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>\s*(.*?)\s*</td>"), 1), lambda c: F.trim(c)), lambda c: c.rlike(r"^\d+$")).alias("c"))
    return cells.where(F.size("c") >= size + 1).select(F.get("c", F.lit(0)).try_cast("bigint").alias("issue"), F.transform(F.slice("c", 2, size), lambda x: x.try_cast("int")).alias("nums"), *keep)


def list_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, item): the texts of the first list of every page."""
    items = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<li>(?:<a[^>]*>)?([^<]*)"), 1)
    return pages.select(key, F.posexplode(items).alias("pos", "item"))


def host_of(url: Column) -> Column:
    """The host of a web address, in lower case; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[Hh][Tt][Tt][Pp][Ss]?://([^/:?#]+)", 1))
    return F.when(host != "", host)


def list_entries(html: Column) -> Column:
    """The entries of a page's lists in their order: structs of item and href (empty if it is no link)."""
    entry = r'(?s)<li>(?:<a(?:[^>]*?\shref="([^"]*)")?[^>]*>)?([^<]*)'
    return F.zip_with(F.regexp_extract_all(html, F.lit(entry), 2), F.regexp_extract_all(html, F.lit(entry), 1), lambda item, href: F.struct(item.alias("item"), href.alias("href")))


def latest_issue(numbers: DataFrame) -> DataFrame:
    return numbers.agg(F.max("issue").alias("issue"))


def sample_rows(results: DataFrame, modulus: int, remainder: int, order: str = "ticket_id", most: int | None = None) -> DataFrame:
    """Rows whose 1-based place in the order (of a number without repetitions) leaves the remainder; the first `most` of them."""
    placed = places(results, order).where(F.pmod("place", F.lit(modulus)) == remainder)
    if most is not None:
        first = remainder % modulus or modulus
        placed = placed.where(F.col("place") < first + most * modulus)
    return placed.withColumn("place", F.col("place").cast("int"))


def write_results(tickets: DataFrame, path: str, pick: int) -> None:
    """Tickets (nums) as CSV with columns b1, b2, ..."""
    tickets.select(*[F.element_at("nums", i + 1).alias(f"b{i + 1}") for i in range(pick)]).write.option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, nums) of result files b1..bk."""
    rows = spark.read.option("header", True).csv(path)
    names = [c for c in rows.columns if c.startswith("b")]
    return rows.select(F.col("_metadata.file_name").alias("file"), F.sort_array(F.array(*[F.col(c).cast("int") for c in names])).alias("nums"))


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    """(pick, thr array of six) as columns s1..s6."""
    thresholds.select("pick", *[F.element_at("thr", i + 1).alias(f"s{i + 1}") for i in range(6)]).write.mode("overwrite").option("header", True).csv(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(pick, thr array of six) as write_thresholds leaves them."""
    rows = spark.read.option("header", True).schema("pick int, " + ", ".join(f"s{i} double" for i in range(1, 7))).csv(path)
    return rows.select("pick", F.array(*[f"s{i}" for i in range(1, 7)]).alias("thr"))
