"""User-facing queries: history, filtered history, find, cat, tool history,
prefix lookup, analyze, prune and batch search -- each one lazy plan.

Order of steps follows the reference where it changes results: noise
patterns apply after a search limit and after the dump limit, before
statistics, and before phrase matching.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import hashlet, index, maintenance, search, stats
from ..operators.filters import scope, with_annotation_type
from ..operators.phrase import phrase_match
from ..operators.squelch import active_list, squelch
from ..operators.util import TOP_K_REACH, materialize, with_position
from ..functions.text import split_keywords
from ..functions.timefmt import relative_time

HIT_COLS = ["hash", "cmd", "cwd", "ts_ms", "source"]


def default_noise():
    return active_list()


def history(hist: DataFrame, cwd: str | None = None, source: str | None = "user",
            squelch_patterns=None, reverse: bool = False, tool: str | None = None,
            category: str | None = None) -> DataFrame:
    """Full history, newest first (``reverse``: oldest first); the directory
    column is cleared when scoped to one directory."""
    rows = squelch(scope(hist, cwd=cwd, source=source, tool=tool, category=category),
                   squelch_patterns)
    if cwd:
        rows = rows.withColumn("cwd", F.lit(""))
    order = [F.col("ts_ms").asc(), F.col("hash").asc()] if reverse else \
        [F.col("ts_ms").desc(), F.col("hash").desc()]
    return rows.select(*HIT_COLS).orderBy(*order)


def filtered_history(hist: DataFrame, phrase: str, cwd: str | None = None,
                     source: str | None = "user", squelch_patterns=None,
                     reverse: bool = False) -> DataFrame:
    """History matching ``phrase``: exact matches first, then fuzzy, each
    newest first; ``reverse`` flips the whole list."""
    rows = squelch(scope(hist, cwd=cwd, source=source), squelch_patterns)
    matched, exact = phrase_match(F.col("cmd"), phrase)
    rows = rows.withColumn("exact", exact).filter(matched)
    if cwd:
        rows = rows.withColumn("cwd", F.lit(""))
    order = [F.col("exact").desc(), F.col("ts_ms").desc(), F.col("hash").desc()]
    if reverse:
        order = [F.col("exact").asc(), F.col("ts_ms").asc(), F.col("hash").asc()]
    return rows.select(*HIT_COLS, "exact").orderBy(*order)


def find(hist: DataFrame, keywords: list[str], limit: int | None = 5, cwd: str | None = None,
         source: str | None = "user", annotations: DataFrame | None = None,
         squelch_patterns=None, reverse: bool = False, clamp: bool = False) -> DataFrame:
    """Ranked search (see ``operators.search.find``)."""
    return search.find(hist, keywords, limit=limit, cwd=cwd, source=source,
                       annotations=annotations, squelch_patterns=squelch_patterns,
                       reverse=reverse, clamp=clamp)


def cat(hist: DataFrame, phrase: str | None = None, limit: int = 0, cwd: str | None = None,
        source: str | None = "user", squelch_patterns=None, reverse: bool = False,
        tool: str | None = None, category: str | None = None) -> DataFrame:
    """Dump oldest first. ``limit`` > 0 keeps the newest ``limit`` rows *before*
    noise and phrase filtering: up to ``TOP_K_REACH`` by a top-k, beyond it by
    positions in a distributed order.

    Output adds ``exact`` (phrase given) and, when limited, ``pos``.
    """
    rows = scope(hist, cwd=cwd, source=source, tool=tool, category=category)
    newest = [F.col("ts_ms").desc(), F.col("hash").desc()]
    limit = limit or 0
    large = limit > TOP_K_REACH
    if large:
        rows = with_position(rows, newest, "_newest").filter(F.col("_newest") <= limit).drop("_newest")
    elif limit > 0:
        rows = rows.orderBy(*newest).limit(limit)
    rows = squelch(rows, squelch_patterns)
    if phrase is not None and phrase != "":
        matched, exact = phrase_match(F.col("cmd"), phrase)
        rows = rows.withColumn("exact", exact).filter(matched)
    else:
        rows = rows.withColumn("exact", F.lit(False))
    if cwd:
        rows = rows.withColumn("cwd", F.lit(""))
    order = [F.col("exact").desc(), F.col("ts_ms").asc(), F.col("hash").asc()]
    if reverse:
        order = [F.col("exact").asc(), F.col("ts_ms").desc(), F.col("hash").desc()]
    if large:
        return with_position(rows, order).select(
            *HIT_COLS, "exact", F.col("pos").cast("int").alias("pos")).orderBy("pos")
    if limit > 0:
        # at most TOP_K_REACH rows: a single-partition window is bounded
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
        return rows.select(*HIT_COLS, "exact", "pos").orderBy("pos")
    return rows.select(*HIT_COLS, "exact").orderBy(*order)


def tool_history(hist: DataFrame, tool: str | None = None, category: str | None = None,
                 tag: str = "agent", squelch_patterns=None, reverse: bool = False) -> DataFrame:
    """Tool-call history (always global), optional tool / category filters,
    newest first."""
    rows = squelch(scope(hist, source=tag, tool=tool, category=category), squelch_patterns)
    order = [F.col("ts_ms").asc(), F.col("hash").asc()] if reverse else \
        [F.col("ts_ms").desc(), F.col("hash").desc()]
    return rows.select(*HIT_COLS, "tool", "category").orderBy(*order)


def resolve_prefixes(hist: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Prefix lookup over all sources, global."""
    return hashlet.resolve_prefixes(hist, prefixes)


def resolve_prefix(hist: DataFrame, prefix: str) -> DataFrame:
    """One prefix: a single row with its status (and the command when found)."""
    one = hist.sparkSession.createDataFrame([(prefix,)], "prefix string")
    return hashlet.resolve_prefixes(hist, one)


def analyze_base(hist: DataFrame, cwd: str | None = None, source: str | None = "user",
                 squelch_patterns=None) -> DataFrame:
    """Statistics scope: global unless a directory is given."""
    return stats.stats_base(hist, cwd=cwd, source=source, squelch_patterns=squelch_patterns)


def prune(hist: DataFrame, idx: DataFrame | None, annotations: DataFrame,
          mark: DataFrame | None = None, unmark: DataFrame | None = None):
    """Apply marks / unmarks, then prune. Returns (candidates, history, index, annotations)."""
    ann = annotations
    if mark is not None:
        ann = maintenance.mark_prune(ann, mark)
    if unmark is not None:
        ann = maintenance.unmark_prune(ann, unmark)
    candidates = maintenance.prune_candidates(hist, ann)
    new_hist, new_idx, new_ann, _ = maintenance.prune_apply(hist, idx, ann)
    return candidates, new_hist, new_idx, new_ann


def hit_view(hits: DataFrame, as_of_ms=None) -> DataFrame:
    """The columns behind a result listing: each hit's shortest unique hash
    prefix *within this result set* (``hashlet``) and a relative-time label.

    The hits are written once, so what produced them runs once; the prefix
    length and the newest time are aggregates over that table (scalar
    subqueries). ``as_of_ms`` defaults to the newest hit, for reproducible labels.
    """
    hits = materialize(hits, "hits")
    n = hashlet.min_hashlet_len(hits.select("hash")).scalar()
    as_of = hits.select(F.max("ts_ms")).scalar() if as_of_ms is None else as_of_ms
    return hits.withColumn("hashlet", F.substring(F.col("hash"), F.lit(1), n)).withColumn(
        "when_label", relative_time(F.col("ts_ms"), as_of))


def keyword_queries(df: DataFrame, qid_col: str, text_col: str, cwd_col: str | None = None) -> DataFrame:
    """Typed query strings -> batch-search queries (keywords split on white space)."""
    cwd = F.col(cwd_col) if cwd_col else F.lit("")
    return df.select(F.col(qid_col).alias("qid"), split_keywords(F.col(text_col)).alias("keywords"),
                     cwd.alias("cwd"))


def batch_search(hist: DataFrame, queries: DataFrame, limit: int | None = 5,
                 source: str | None = "user", idx: DataFrame | None = None,
                 annotations: DataFrame | None = None, squelch_patterns=None) -> DataFrame:
    return index.batch_search(hist, queries, limit=limit, source=source, index=idx,
                              annotations=annotations, squelch_patterns=squelch_patterns)


__all__ = ["history", "filtered_history", "find", "cat", "tool_history", "resolve_prefixes",
           "analyze_base", "prune", "batch_search", "with_annotation_type", "default_noise"]
