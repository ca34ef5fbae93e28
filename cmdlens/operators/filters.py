"""Scope predicates: directory, source tag, tool and category (pushed to the scan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_SOURCES = "all"
USER_SOURCE = "user"


def source_predicate(source: str | None) -> Column | None:
    """``all`` = no filter; ``user`` / empty = untagged rows only; else the tag."""
    if source == ALL_SOURCES:
        return None
    if source in (None, "", USER_SOURCE):
        return F.col("source") == ""
    return F.col("source") == F.lit(source)


def scope(df: DataFrame, cwd: str | None = None, source: str | None = USER_SOURCE,
          tool: str | None = None, category: str | None = None) -> DataFrame:
    """Exact-directory, source, tool and category filters; empty = no filter."""
    preds = []
    if cwd:
        preds.append(F.col("cwd") == F.lit(cwd))
    sp = source_predicate(source)
    if sp is not None:
        preds.append(sp)
    if tool:
        preds.append(F.col("tool") == F.lit(tool))
    if category:
        preds.append(F.col("category") == F.lit(category))
    for p in preds:
        df = df.filter(p)
    return df


def with_annotation_type(hits: DataFrame, annotations: DataFrame | None) -> DataFrame:
    """Attach ``annotation_type`` (0 normal, 1 marked for prune) to a hit list.

    ``hits`` is the outer side of a join that Spark plans from the sizes it
    measures: a short hit list is sent to the annotations, not the other way.
    """
    if annotations is None:
        return hits.withColumn("annotation_type", F.lit(0))
    ann = annotations.select("hash", F.col("type").alias("_atype"))
    joined = ann.join(hits, "hash", "right")
    return joined.withColumn("annotation_type", F.coalesce(F.col("_atype"), F.lit(0))).drop("_atype")
