"""The corpus pipeline: quality rules, near-dedup, decontamination, surrogates for personal data, packing.

Each stage works on all that the one before kept, and its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlens.llm import decontamination, near_dedup, packing, pii, quality_rules
from wardlens.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.filter_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of 13 benchmark words or more go, long ones too."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts; no document goes."""
    return pii.stage(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.stage(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("pii", surrogates),
    ("packing", packed),
]

#: SQL can't express near-dedup, surrogates and packing; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
