"""Corpus preparation: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.

Defined cases, in every stage: an empty table gives an empty one; texts are read whole,
however long; columns besides doc_id, text, lang and source may have any name that doesn't
begin with __strand, and all but the last stage hand every column on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strand.llm import packing, quality, simhash, toxicity
from strand.llm.common import saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep.

    Null and empty texts have no words and go; null languages and sources are groups of their
    own; repeated rows are judged alike and stay or go together; a measure that equals its
    fence is inside it.
    """
    return quality.quality_filter(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance score doesn't call toxic (score below 0.5).

    Null and empty texts get the score of no savings, which stays; without labels of both
    kinds the share of toxic labels decides for all; repeated rows stay or go together.
    """
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    A null id stays only in a group without others; of rows with the same id the first
    written stays; null and empty texts are copies of each other.
    """
    return simhash.near_duplicate_filter(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, placed in sequences.

    A null or empty text is its end id alone; repeated rows and ids are packed each; pieces
    of equal length take their places in the order they were written.
    """
    return packing.digest(docs, packing.word_file())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Tokenising and compression have no SQL form; the tests hold the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
