"""Ranked keyword search with local-to-global and ranked-to-scan fallback.

The reference runs up to four queries in sequence (local ranked, local scan,
global ranked, global scan), stopping at the first non-empty one. Here each
row gets the lowest tier it qualifies for in a single pass:

    1 local & rank > 0    2 local & substring hit
    3 rank > 0            4 substring hit

``rank`` is the number of distinct query trigrams the command contains (what
the inverted index counts), looked up in the row's own windows, so the ad-hoc
search needs neither the index nor a shuffle. Rows are ordered by (tier, rank
desc for ranked tiers, ts desc, hash) and the top ``limit`` are taken with a
per-partition top-k (``TakeOrderedAndProject``); of those only the rows of the
best tier are kept. This is exact: the best tier sorts first, so if it has any
rows they lead the list. A limit beyond ``TOP_K_REACH`` takes the best tier
first and positions from a distributed order, with no single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import found_keywords, holds_any
from ..functions.ngrams import gram_bytes, trigram_windows, trigrams_of
from ..functions.text import split_keywords_py
from ..schema import HITS_COLUMNS
from .filters import scope, with_annotation_type
from .squelch import squelch
from .util import TOP_K_REACH, materialize, spread, with_position

DEFAULT_LIMIT = 5


def normalize_limit(limit: int | None, clamp: bool = False) -> int:
    """<= 0 means the default (5); ``clamp`` applies the 5..20 configured range."""
    if limit is None or limit <= 0:
        return DEFAULT_LIMIT
    if clamp:
        return min(20, max(5, limit))
    return limit


def _bytes_len(s: str) -> int:
    return len(s.encode("utf-8"))


def query_grams(keywords: list[str]) -> list[int]:
    """Distinct trigrams of the keywords longer than two bytes (none across keywords)."""
    seen: dict[int, None] = {}
    for kw in keywords:
        if _bytes_len(kw) > 2:
            for g in trigrams_of(kw):
                seen.setdefault(g, None)
    return list(seen)


def rank_column(cmd: Column, grams: list[int]) -> Column:
    """Number of the distinct query trigrams present in ``cmd``: its windows are looked up in
    the set of the query's, whatever their number."""
    if not grams:
        return F.lit(0)
    wanted = [gram_bytes(g).decode("latin-1") for g in grams]
    return F.size(F.array_distinct(F.filter(trigram_windows(cmd), lambda w: w.isin(wanted))))


def scan_column(cmd: Column, keywords: list[str]) -> Column:
    """True when ``cmd`` contains any non-empty keyword (case-sensitive)."""
    return holds_any(cmd, keywords)


def tier_column(rank: Column, scan: Column, local: Column | None, ranked: bool) -> Column:
    branches: list[tuple[Column, int]] = []
    if local is not None:
        if ranked:
            branches.append((local & (rank > 0), 1))
        branches.append((local & scan, 2))
    if ranked:
        branches.append((rank > 0, 3))
    branches.append((scan, 4))
    expr = None
    for cond, tier in branches:
        expr = F.when(cond, F.lit(tier)) if expr is None else expr.when(cond, F.lit(tier))
    return expr


def empty_hits(history: DataFrame) -> DataFrame:
    return history.select(
        "hash", "cmd", "cwd", "ts_ms", F.lit(0).alias("annotation_type"), "source",
        F.lit(False).alias("is_global"), F.lit(0).alias("rank"), F.lit(0).alias("pos")).limit(0)


def find(history: DataFrame, keywords: list[str] | str, limit: int | None = DEFAULT_LIMIT,
         cwd: str | None = None, source: str | None = "user",
         annotations: DataFrame | None = None, squelch_patterns=None,
         reverse: bool = False, clear_cwd: bool = True, clamp: bool = False) -> DataFrame:
    """Top ``limit`` hits for ``keywords``; noise patterns apply after the limit, which
    ``clamp`` brings into the configured range of 5 to 20.

    Columns: hash, cmd, cwd, ts_ms, annotation_type, source, is_global, rank, pos
    (pos = 1-based output position; ``reverse`` flips it).
    """
    if isinstance(keywords, str):          # a typed query string: split on white space
        keywords = split_keywords_py(keywords)
    n = normalize_limit(limit, clamp)
    if not any(keywords):
        return empty_hits(history)
    grams = query_grams(keywords)
    ranked = bool(grams)
    base = scope(history, source=source)
    cmd = F.col("cmd")
    rank = rank_column(cmd, grams) if ranked else F.lit(0)
    local = (F.col("cwd") == F.lit(cwd)) if cwd else None
    scored = (base.withColumn("rank", rank)
              .withColumn("tier", tier_column(F.col("rank"), scan_column(cmd, keywords),
                                              local, ranked))
              .filter(F.col("tier").isNotNull())
              .withColumn("rank_key", F.when(F.col("tier").isin(1, 3), F.col("rank"))
                          .otherwise(F.lit(0))))
    order = [F.col("tier").asc(), F.col("rank_key").desc(), F.col("ts_ms").desc(),
             F.col("hash").asc()]
    large = n > TOP_K_REACH
    everything = Window.partitionBy(F.lit(1))
    if large:
        scored = materialize(scored, "scored")
        best = scored.filter(F.col("tier") == scored.select(F.min("tier")).scalar())
        top = with_position(best, order, "_at", "scored-order").filter(F.col("_at") <= n).drop("_at")
    else:
        # keep the best tier only (the window spans at most ``limit`` rows)
        top = scored.orderBy(*order).limit(n)
        top = (top.withColumn("_best", F.min("tier").over(everything))
               .filter(F.col("tier") == F.col("_best")))
    hits = with_annotation_type(top, annotations)
    hits = squelch(hits, squelch_patterns)
    is_global = F.lit(False) if not cwd else (F.col("tier") >= 3)
    hits = hits.withColumn("is_global", is_global)
    if cwd and clear_cwd:
        hits = hits.withColumn("cwd", F.when(F.col("is_global"), F.col("cwd")).otherwise(F.lit("")))
    pos_order = [F.col("rank_key").desc(), F.col("ts_ms").desc(), F.col("hash").asc()]
    if reverse:
        pos_order = [F.col("rank_key").asc(), F.col("ts_ms").asc(), F.col("hash").desc()]
    if large:
        hits = with_position(hits, pos_order, "pos", "hit-order").withColumn("pos", F.col("pos").cast("int"))
    else:
        hits = hits.withColumn("pos", F.row_number().over(everything.orderBy(*pos_order)))
    return hits.select(*HITS_COLUMNS, "is_global", F.col("rank").cast("int").alias("rank"), "pos").orderBy("pos")


def keyword_hits(rows: DataFrame, keywords: list[str], text_col: str = "cmd") -> DataFrame:
    """Rows that hold any of the keywords, with ``found``, those they hold, in one pass whatever their number."""
    # a generator's output: the filter is not copied below it, where each text would be searched twice
    found = F.explode(F.array(found_keywords(text_col, keywords))).alias("found")
    return spread(rows, text_col).select("*", found).filter(F.size("found") > 0)
