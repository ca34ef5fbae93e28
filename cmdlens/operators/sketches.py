"""Statistics that can be kept and merged: distinct counts by HyperLogLog, top lists by frequent-item sketches.

A sketch is made per part of the log (a day, a directory), stored as a small binary
column, and merged for any set of parts without reading the log again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import program_name
from .stats import local_time, top_counts

LG_K = 12                 # 2^12 registers: relative standard error 1.6 %
TRACKED = 10_000          # items a frequent-item sketch keeps
# A sketch of map size m errs by at most 3.5 / m of the rows it saw; Spark's holds ``tracked`` in a map at
# most three quarters full.
ERROR = 3.5 * 0.75


def distinct_sketches(base: DataFrame, tz: str | None = "UTC", lg_k: int = LG_K) -> DataFrame:
    """(day, cwd, n, commands, programs): rows and sketches of the distinct commands and programs."""
    day = F.date_format(local_time(F.col("ts_ms"), tz), "yyyy-MM-dd")
    return base.groupBy(day.alias("day"), "cwd").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("cmd", F.lit(lg_k)).alias("commands"),
        F.hll_sketch_agg(program_name("cmd"), F.lit(lg_k)).alias("programs"))


def distinct_in_ranges(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per range (name, from_day, to_day, both included): name, n, unique_commands, unique_programs,
    the last two estimated by merging the days' sketches."""
    days = ranges.select("name", F.explode(F.sequence(F.to_date("from_day"), F.to_date("to_day"))).alias("_d"))
    days = days.select("name", F.date_format("_d", "yyyy-MM-dd").alias("day"))
    return sketches.join(days, "day").groupBy("name").agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("commands")).alias("unique_commands"),
        F.hll_sketch_estimate(F.hll_union_agg("programs")).alias("unique_programs"))


def _call(name: str, *args) -> Column:
    return F.call_function(name, *args)


def frequent_sketches(rows: DataFrame, label: Column, part: Column | None = None, tracked: int = TRACKED) -> DataFrame:
    """Per ``part`` (a day, say): part, n, items (a frequent-item sketch of the non-null labels), in one pass with partial sketches."""
    labelled = rows.select((F.lit("") if part is None else part).alias("part"), label.alias("_label")).filter("_label is not null")
    return labelled.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), _call("approx_top_k_accumulate", F.col("_label"), F.lit(tracked)).alias("items"))


def top_list_sketched(rows: DataFrame, label: Column, n: int, sketches: DataFrame | None = None, tracked: int = TRACKED) -> DataFrame:
    """Exact (label, count) top ``n`` by count desc, label asc, from sketches and a recount.

    The merged sketch names every label whose count exceeds twice its error (``ERROR / tracked`` of the
    rows); only these, at most ``tracked``, are counted exactly, so no exchange holds all labels. If the
    n-th count found does not exceed that limit, and the candidates do not cover all rows, a label that
    the sketch dropped might belong to the list: then all labels are counted.
    """
    sketches = frequent_sketches(rows, label, tracked=tracked) if sketches is None else sketches
    merged = sketches.agg(F.sum("n").alias("n"), _call("approx_top_k_combine", F.col("items"), F.lit(tracked)).alias("items"))
    total = merged.select(F.coalesce("n", F.lit(0)).alias("n")).first()["n"]
    if not total:
        return top_counts(rows, label, n)
    found = merged.select(F.explode(_call("approx_top_k_estimate", F.col("items"), F.lit(tracked))).alias("i")).select(
        F.col("i.item").alias("_label"))
    # at most ``tracked`` candidates
    counts = (rows.select(label.alias("_label")).join(F.broadcast(found), "_label", "left_semi")
              .groupBy("_label").agg(F.count(F.lit(1)).alias("count")))
    top = counts.orderBy(F.col("count").desc(), F.col("_label").asc()).limit(n).select(F.col("_label").alias("label"), "count")
    seen = counts.agg(F.sum("count").alias("covered"), F.count(F.lit(1)).alias("k")).first()
    nth = top.agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("least")).first()
    if seen["covered"] == total or (nth["k"] == n and nth["least"] > 2 * ERROR / tracked * total):
        return top
    return top_counts(rows, label, n)
