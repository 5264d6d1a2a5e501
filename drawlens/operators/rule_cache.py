"""Mined rules kept for as long as they are fresh and the draws that they were mined from are the same.

    rules/key=K/version=V/     one mining of rules
    manifest/version=V/        JSON, a row for each version that is complete: key, rules, written_at

A version gets its manifest row after its rules are written, and nobody reads a version without one: readers never see half
a table, and two writers of one key, who share no folder, leave two whole versions, of which the newest counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pairs import association_rules

RULES = "antecedent array<int>, consequent int, support double, confidence double, lift double"
MANIFEST = "key string, rules bigint, written_at timestamp, version string"


def fingerprint(h: DataFrame) -> str:
    """Tells histories apart by what they hold, whatever the order of their rows: one pass, three numbers."""
    own = h.agg(F.count("*").alias("n"), F.sum(F.xxhash64("issue", "num").cast("decimal(20,0)")).alias("h"), F.max("issue").alias("last")).first()
    return f"{own['n']}/{own['h']}/{own['last']}"


def cache_key(h: DataFrame, **parameters: object) -> str:
    told = json.dumps({"draws": fingerprint(h), **parameters}, sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def _read(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(rules: DataFrame, path: str, key: str) -> str:
    """Writes a version and then its row in the manifest; returns the version."""
    spark, version = rules.sparkSession, uuid.uuid4().hex
    where = f"{path}/rules/key={key}/version={version}"
    rules.write.parquet(where)
    row = spark.read.parquet(where).agg(F.count("*").alias("rules"))
    row = row.select(F.lit(key).alias("key"), "rules", F.current_timestamp().alias("written_at"))
    row.coalesce(1).write.json(f"{path}/manifest/version={version}")  # a folder of its own: writers never meet
    return version


def lookup(spark: SparkSession, path: str, key: str, ttl: float = 0) -> DataFrame | None:
    """The newest complete version of a key, if it is younger than `ttl` seconds (0 or less: of any age)."""
    known = _read(spark, f"{path}/manifest", MANIFEST, "json")
    if known is None:
        return None
    own = known.where(F.col("key") == key)
    if ttl > 0:
        own = own.where(F.col("written_at") > F.expr(f"current_timestamp() - make_dt_interval(0, 0, 0, {float(ttl)})"))
    newest = own.orderBy(F.desc("written_at"), "version").limit(1).collect()
    return _read(spark, f"{path}/rules/key={key}/version={newest[0]['version']}", RULES, "parquet") if newest else None


def cached_rules(h: DataFrame, path: str, support: float = 0.08, confidence: float = 0.3, most: int = 2, ttl: float = 86400) -> DataFrame:
    """The rules of h: those kept under the same parameters for the same draws if they are fresh, else mined and kept."""
    key = cache_key(h, support=support, confidence=confidence, most=most)
    known = lookup(h.sparkSession, path, key, ttl)
    if known is not None:
        return known
    publish(association_rules(h, support, confidence, most), path, key)
    return lookup(h.sparkSession, path, key)
