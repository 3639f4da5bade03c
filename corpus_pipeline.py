"""A training-data pipeline over `documents`: language ID, near-duplicate
removal, benchmark decontamination, source mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; its result is written as Parquet and read again as the
next one's `docs`. All but the last return the columns of `documents`.

Defined cases, for all stages: null ids, sources and languages are values like
others; repeated rows count each for itself; long texts are taken whole; an
empty table gives an empty result; columns beyond those of `documents` are kept,
whatever their names, by all stages but the last. Null and empty texts go in
the first stage, as they have no letter; a later stage that is given them keeps
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, decontamination, jaccard_join, language_id, mixing, sharding


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null texts and texts
    without a letter. Between languages with equal distances the first by
    name is taken; no document goes for that."""
    return language_id.kept(docs, language_id.learned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document by id of every group of near duplicates, by
    shingles of five words and a similarity of 0.8 or more. Of rows with equal
    ids any one is kept, a null id comes last; texts without a word stay."""
    return jaccard_join.one_of_each(docs, measure=jaccard_join.PIPELINE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of `benchmark`, each judged by its own
    text. Items of fewer than five words and null items are in no document."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's budget gives. Rows that agree
    in id and length are taken or left together."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the rows into eight shards of near equal bytes; equal texts stay
    together, and rows with equal ids have slots by text."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", without_benchmark),
    ("source_mixing", mixture),
    ("sharding", shards),
]

#: Profiles learned by rank and edit distances aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table `documents` of `sf_dir`."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
