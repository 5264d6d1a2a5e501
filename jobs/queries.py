"""The jobs as queries: each runs twice into a new folder and returns its whole output, and its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.config import PRIZES
from drawlens.plans.folders import workspace
from jobs import backtest_report, common, page_ingest


def job1_page_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = workspace(spark, "page-ingest"), common.configured(page_ingest.Config, page_ingest.CONFIG)
    for _ in range(2):
        page_ingest.run(spark, f"{sf_dir}/pages.parquet", f"{out}/output", f"{out}/checkpoint", config)
    return page_ingest.read_items(spark, f"{out}/output")


def job2_backtest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = workspace(spark, "backtest-report"), common.configured(backtest_report.Config, backtest_report.CONFIG)
    for _ in range(2):
        backtest_report.run(spark, f"{sf_dir}/lineitem.parquet", out, config)
    return backtest_report.read_report(spark, out).withColumn("prize", F.col("prize").cast("double"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_page_ingest, job2_backtest_report)}


_ENTRY = r"(?s)<li>(?:<a(?:[^>]*?\shref=\"([^\"]*)\")?[^>]*>)?([^<]*)"


def _order(multiplier: int) -> str:
    return f"ROW_NUMBER() OVER (PARTITION BY d ORDER BY (num * {multiplier} + d * 11) % 83)"


_PRIZE = ", ".join(f"({pick}, {pick - i}, CAST({amount} AS DECIMAL(12,2)))" for pick, own in PRIZES.items() for i, amount in enumerate(own))

ORACLES = {
    "job1_page_ingest": f"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[Hh][Tt][Tt][Pp][Ss]?://([^/:?#]+)', 1)) AS host, regexp_extract_all(html, '{_ENTRY}', 2) AS items, regexp_extract_all(html, '{_ENTRY}', 1) AS hrefs FROM pages),
e AS (SELECT page_id, host, unnest(range(0, len(items))) AS pos, unnest(items) AS item, unnest(hrefs) AS href FROM p WHERE regexp_matches('.' || host, '\\.example\\.(com|org|net)$'))
SELECT page_id, host, regexp_extract(host, '[^.]*$') AS tld, CAST(pos AS INT) AS pos, item, href FROM e""",
    "job2_backtest_report": f"""
WITH n AS (SELECT DISTINCT CAST(FLOOR(l_orderkey / 10) AS BIGINT) AS d, CAST(1 + l_partkey % 80 AS INT) AS num FROM lineitem),
r AS (SELECT d, num, {_order(37)} AS draw_place, {_order(41)} AS rk, COUNT(*) OVER (PARTITION BY d) AS c FROM n),
dn AS (SELECT d, num, DENSE_RANK() OVER (ORDER BY d) AS place FROM r WHERE draw_place <= 20 AND c >= 20),
tk AS (SELECT d, num, rk, DENSE_RANK() OVER (ORDER BY d) AS place FROM r WHERE rk <= 10 AND c >= 20),
k AS (SELECT unnest(range(1, 11)) AS pick),
h AS (SELECT tk.d, k.pick, COUNT(dn.num) AS hits FROM tk JOIN k ON tk.rk <= k.pick LEFT JOIN dn ON dn.place = tk.place + 1 AND dn.num = tk.num
      WHERE tk.place < (SELECT MAX(place) FROM dn) GROUP BY tk.d, k.pick),
z AS (SELECT * FROM (VALUES {_PRIZE}) AS t(pick, hits, amount)),
b AS (SELECT h.pick, (2020000 + d) // 100 AS block, h.hits, COUNT(*) AS tickets, SUM(amount) AS prize FROM h JOIN z ON z.pick = h.pick AND z.hits = h.hits GROUP BY 1, 2, 3),
a AS (SELECT pick, block, hits, SUM(tickets) AS tickets, SUM(prize) AS prize FROM b GROUP BY GROUPING SETS ((pick, block, hits), (pick, block)))
SELECT CAST(hits AS INT) AS hits, CAST(tickets AS BIGINT) AS tickets, CAST(prize AS DOUBLE) AS prize, CAST(tickets * 2 AS BIGINT) AS stake,
       ROUND(CAST(prize AS DOUBLE) / CAST(tickets * 2 AS DOUBLE) * 100, 4) AS return_rate, CAST(pick AS INT) AS pick, CAST(block AS BIGINT) AS block FROM a""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
