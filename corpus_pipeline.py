"""Corpus preparation: each stage takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vendorscope.llm.common import read_table, stored
from vendorscope.llm.exact_dedup import drop_copies
from vendorscope.llm.jaccard_join import keep_first_of_groups
from vendorscope.llm.langid import keep_identified
from vendorscope.llm.packing import pack
from vendorscope.llm.toxicity import keep_clean


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic stay."""
    return keep_clean(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, similarity of 0.8 or
    more) the one with the smallest id stays."""
    return keep_first_of_groups(docs, words=5, num=80, den=100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("exact_copies", exact_copies),
          ("near_copies", near_copies), ("packing", packing)]

#: The classifiers and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
