"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, with their columns
unchanged; the last one gives the packing plan.  Null and empty texts fail the quality rules, so an
empty table stays empty through all stages.  Repeated rows are kept or dropped together, further columns
pass through, and rows without a doc_id are not compared with others.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaptree.llm import minhash, packing, pii, quality
from snaptree.llm.common import cleaned, saved, table
from snaptree.llm.queries import pii_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates (five words, 0.8)."""
    return minhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data under the session's key."""
    return pii.pseudonymise(docs, key=pii_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its bin and place in it."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("pii", personal_data), ("packing", pack)]

#: Pseudonyms and best fit have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


@cleaned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing plan of documents after all stages; the tables between the stages are removed."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
