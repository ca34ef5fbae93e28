"""The corpus pipeline: quality rules, exact and near deduplication, pseudonyms, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and reread as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cmdlens.llm import chunk_dedup, feistel_pii, harmonic_pack, simhash_dedup, suffix_quality
from cmdlens.llm.common import documents, free_name, stored, tuned
from cmdlens.llm.queries import PSEUDONYM_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the suffix-array repetition limits."""
    return suffix_quality.keep_good(_tuned(spark, docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group equal up to ASCII white space."""
    return chunk_dedup.drop_duplicates(_tuned(spark, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links (3-word shingles, 3 bits)."""
    return simhash_dedup.drop_near_duplicates(_tuned(spark, docs), 3, 3)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` replaced by format-preserving pseudonyms."""
    found = free_name(docs, "_pseudonyms")
    return feistel_pii.pseudonymise(_tuned(spark, docs), PSEUDONYM_KEY, found_col=found).drop(found)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents packed into sequences of 1024 ids."""
    return harmonic_pack.pack(_tuned(spark, docs)).drop("class")


def _tuned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    tuned(spark)
    return docs


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup),
          ("pseudonyms", pseudonyms), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read back."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs


# Suffix arrays, SimHash, Feistel rounds and tokenisers have no SQL form; tests compare with brute force.
ORACLE_SQL = None
