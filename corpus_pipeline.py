"""From raw documents to token ids: quality, lines, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
``documents``; the last returns a row of digests for each document it is given. A stage works on
all documents that the one before has kept, as they were written down.

Defined results: null and empty texts have no words, so quality_rules drops them; given to a later stage they stay as
they are, a null one has zero tokens, and near_duplicates keeps one of them all. Nulls in other columns go through
(unknown language: base rules only; unknown source: a domain of its own). Rows with equal number and text are one document for
line_dedup and near_duplicates and lose the same lines; of a group the smallest number stays, null last. Texts of any
length are processed whole. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echocache.llm import lines, quality, simhash
from echocache.llm.queries import bpe_digests, mixed
from echocache.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or are far from their language, go."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines one occurrence stays; documents lose the others from their text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.without_near_duplicates(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of domains, languages and sources, once for each epoch."""
    return mixed(docs).drop("mix")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, and come back from them."""
    return bpe_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("token_ids", token_ids),
]

#: SQL cannot express the fingerprints' hash; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
