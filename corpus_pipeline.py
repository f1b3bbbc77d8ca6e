"""A corpus in four stages: language identification, near duplicates, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import langid, neardup, packing, secrets
from quern.llm.common import checkpointed, table

#: A text under this score is far from every language's profile. Clean texts of one word have more than twice that.
LEAST_SCORE = 0.15


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; profiles are fitted on the input's labelled rows outside the held-out fold."""
    labelled = table(spark, sf_dir, "documents").filter(~langid.held_out())
    return langid.keep_identified(docs, langid.fit_profiles(labelled), LEAST_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets and n_chars counted anew."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language id", identify), ("near duplicates", deduplicate), ("secrets", redact), ("packing", pack)]

#: Near duplicates and token ids can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
