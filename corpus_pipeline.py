"""A training-data pipeline: toxicity, near-dedup, substring dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of docs. The last returns the tokens' digest of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.llm import bpe, decontam, neardup, substring, toxicity
from drawlens.llm.common import materialise, table
from drawlens.llm.queries import tokenizer
from drawlens.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled rows among docs outside fold 0."""
    model = toxicity.train(docs, table(ship(spark), sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return neardup.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 35 words that occurs elsewhere go; the row stays, with the length of its new text."""
    ship(spark)
    text = substring.without_repeats(docs)
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return text


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.drop_leaks(docs, table(ship(spark), sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    ship(spark)
    return bpe.tokenize(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", tokens),
]

#: A model, verified near copies and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
