"""A cleaning pipeline over documents: five stages, each written as Parquet and read again by the next.

A null text is the empty text: the quality classifier decides on it as on any other, of several the one with the
smallest doc_id stays, and near copies and passages do not concern it. A document of which cutting passages leaves only
white characters goes. Rows without doc_id are no near copies and share no passages; they stay unless equal to another
text. Of repeated rows one stays; rows that have one doc_id and different texts are not cut. Texts are read whole at any
length, columns of any name come along up to the last stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import exact, jaccard, packing, quality, substrings
from geoloom.llm.common import new_path
from geoloom.llm.queries import table, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, does not reject."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return substrings.cut(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_classifier), ("exact", exact_dedup), ("jaccard", ngram_jaccard), ("suffixes", suffix_array_dedup), ("packing", pack)]

#: SQL cannot fit the classifier or encode tokens: tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
