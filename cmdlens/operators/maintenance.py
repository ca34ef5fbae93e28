"""Prune marks and pruning, as set operations on whole tables.

Tables are immutable DataFrames; every "write" returns the new version
(to be written to a new path and switched to), so a failed job never leaves
a half-applied prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRUNE_TYPE = 1
PRUNE_DESC = "prune"


def mark_prune(annotations: DataFrame, hashes: DataFrame) -> DataFrame:
    """Upsert a prune mark (type 1, 'prune') for every hash in ``hashes``."""
    marks = hashes.select("hash").distinct().select(
        "hash", F.lit(PRUNE_TYPE).alias("type"), F.lit(PRUNE_DESC).alias("desc"))
    kept = annotations.join(marks.select("hash"), "hash", "left_anti")
    return kept.unionByName(marks)


def unmark_prune(annotations: DataFrame, hashes: DataFrame) -> DataFrame:
    """Delete prune marks (type 1 only) of the given hashes."""
    gone = annotations.filter(F.col("type") == PRUNE_TYPE).join(
        hashes.select("hash").distinct(), "hash", "left_semi")
    return annotations.join(gone.select("hash", "type"), ["hash", "type"], "left_anti")


def prune_candidates(history: DataFrame, annotations: DataFrame) -> DataFrame:
    """History rows carrying a prune mark (one per hash; scope filters ignored)."""
    marks = annotations.filter(F.col("type") == PRUNE_TYPE).select("hash")
    return history.join(marks, "hash", "left_semi")


def prune_count(history: DataFrame, annotations: DataFrame) -> DataFrame:
    return prune_candidates(history, annotations).agg(F.count("*").alias("pruned"))


def prune_apply(history: DataFrame, index: DataFrame | None, annotations: DataFrame,
                meta: DataFrame | None = None):
    """Delete marked hashes from history and index, then drop the marks.

    Returns (history, index, annotations, meta). Metadata rows are kept, so a
    command indexed again later gets its old tags back.
    """
    marks = annotations.filter(F.col("type") == PRUNE_TYPE).select("hash").distinct()
    new_history = history.join(marks, "hash", "left_anti")
    new_index = index.join(marks, "hash", "left_anti") if index is not None else None
    new_annotations = annotations.filter(F.col("type") != PRUNE_TYPE)
    return new_history, new_index, new_annotations, meta
