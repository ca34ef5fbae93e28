"""Cross-site boilerplate lines by distinct-site spread.

A line (without ASCII white space at its ends) that occurs on many distinct sites
is boilerplate. Each line hash gets a HyperLogLog sketch of its sites; sketches
are built in every task and merged by the aggregation. Lines whose estimate is
clear of the threshold are decided by it; lines near the threshold are counted
exactly. Boilerplate lines are then removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, stored, text_key

MIN_SITES = 8
LG_K = 10                     # sketch of 2^10 registers: relative error 3.3 %
BAND = 0.15                   # of the threshold, above four errors: counted exactly


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(ASCII_SPACE))


def line_hash(line: Column) -> Column:
    """128-bit hash of a trimmed line."""
    return F.unhex(F.md5(_trimmed(line)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _distinct_hashes(text: Column) -> Column:
    """Hashes of a text's distinct lines that hold more than white space."""
    some = F.filter(F.transform(_lines(text), _trimmed), lambda x: x != "")
    return F.transform(F.array_distinct(some), lambda x: F.unhex(F.md5(x)))


def boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES,
                lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """Hashes (h) of the lines found on at least ``min_sites`` sites. A null site counts as none."""
    each = docs.select(F.explode(_distinct_hashes(F.col("text"))).alias("h"), F.col(site_col).alias("site"))
    sketched = each.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    # what lies clearly below is not kept: the table holds candidates only
    likely = stored(sketched.filter(F.col("estimate") >= F.lit(min_sites * (1 - band))), "line-spread")
    sure = likely.filter(F.col("estimate") > F.lit(min_sites * (1 + band))).select("h")
    near = likely.filter(F.col("estimate") <= F.lit(min_sites * (1 + band))).select("h")
    exact = (each.filter("site is not null").join(near, "h", "left_semi").distinct()
             .groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h"))
    return stored(sure.union(exact), "boilerplate-lines")


def remove_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_text.

    All occurrences of a boilerplate line go; the other lines, blank ones
    included, stay as written, joined by line feeds. A null text counts as empty:
    one line, nothing removed. Repeated rows are treated alike. The work on a text is linear in its
    lines; a text and its lines are held in memory together.
    """
    bad = boilerplate(docs, site_col, min_sites)
    key = text_key(F.col("doc_id"), F.col("text"))
    numbered = docs.select(key.alias("_key"), F.posexplode(F.transform(_lines(F.col("text")), _trimmed)).alias("at", "line"))
    found = (numbered.filter("line <> ''").select("_key", "at", F.unhex(F.md5("line")).alias("h"))
             .join(bad, "h").groupBy("_key").agg(F.array_sort(F.collect_set("at")).alias("bad")))
    rows = docs.select(key.alias("_key"), "doc_id", "text").join(found, "_key", "left")
    out = rows.select("doc_id", _lines(F.col("text")).alias("lines"), "bad")
    return out.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("bad"), F.lit(0)).cast("bigint").alias("n_removed"),
                      F.when(F.col("bad").isNull(), F.array_join("lines", "\n"))
                      .otherwise(F.array_join(_without(F.col("lines"), F.col("bad")), "\n")).alias("kept_text"))


def _without(items: Column, places: Column) -> Column:
    """``items`` without those at ``places`` (sorted, from 0): the stretches between them, joined."""
    def stretch(i):
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1) + 1)
        end = F.when(i == F.size(places), F.size(items)).otherwise(F.get(places, i))
        return F.slice(items, start + 1, end - start)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), stretch))
