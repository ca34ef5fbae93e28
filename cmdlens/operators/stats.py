"""Usage statistics: totals, top lists, hourly / daily distributions, heatmap.

Every statistic is an aggregation over one filtered base (scope + noise
filter). Counts are partial-aggregated map-side, so a label holding a third
of all rows costs one row per task before the shuffle; top lists are then a
per-partition top-k (``TakeOrderedAndProject``) over the grouped rows. Shares
divide by a scalar subquery (the total), not by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.category import category
from ..functions.text import program_name
from ..functions.timefmt import heat_level
from .filters import scope
from .squelch import squelch

TOP_COMMANDS = 15
TOP_PROGRAMS = 15
TOP_CATEGORIES = 10
TOP_DIRS = 10
DEFAULT_HEATMAP_WEEKS = 52
MS_PER_DAY = 86_400_000


def stats_base(history: DataFrame, cwd: str | None = None, source: str | None = "user",
               squelch_patterns=None) -> DataFrame:
    """Scope filter, then noise filter: the rows every statistic counts."""
    return squelch(scope(history, cwd=cwd, source=source), squelch_patterns)


def local_time(ts_ms: Column, tz: str | None) -> Column:
    t = F.timestamp_millis(ts_ms)
    return t if tz in (None, "UTC") else F.from_utc_timestamp(t, tz)


def overview(base: DataFrame, approximate: float | None = None) -> DataFrame:
    """One row: total, unique commands / programs, first / last seen, average per day.

    ``approximate``: relative error at which the two distinct counts are
    estimated by sketches instead of being counted exactly (one pass, no
    exchange of commands).
    """
    def distinct(c: Column) -> Column:
        return F.count_distinct(c) if approximate is None else F.approx_count_distinct(c, approximate)

    agg = base.agg(
        F.count("*").alias("total_commands"),
        distinct(F.col("cmd")).alias("unique_commands"),
        distinct(program_name("cmd")).alias("unique_programs"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.max("ts_ms").alias("last_ts_ms"),
    )
    days = F.greatest(F.lit(1.0), (F.col("last_ts_ms") - F.col("first_ts_ms")) / F.lit(float(MS_PER_DAY)))
    return agg.withColumn(
        "avg_per_day",
        F.when(F.col("total_commands") > 0, F.col("total_commands") / days).otherwise(F.lit(0.0)))


def label_column(kind: str) -> Column:
    if kind == "commands":
        return F.col("cmd")
    if kind == "programs":
        return program_name("cmd")
    if kind == "categories":
        return category("cmd")
    if kind == "dirs":
        return F.col("cwd")
    raise ValueError(f"unknown top-list kind {kind!r}")


DEFAULT_TOP = {"commands": TOP_COMMANDS, "programs": TOP_PROGRAMS,
               "categories": TOP_CATEGORIES, "dirs": TOP_DIRS}


def top_list(base: DataFrame, kind: str, n: int | None = None) -> DataFrame:
    """(label, count) top ``n`` by count desc, label asc; blank directories skipped."""
    n = DEFAULT_TOP[kind] if n is None else n
    rows = base.filter(F.col("cwd") != "") if kind == "dirs" else base
    return top_counts(rows, label_column(kind), n)


def top_counts(rows: DataFrame, label: Column, n: int) -> DataFrame:
    counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("label").asc()).limit(n)


def top_list_view(base: DataFrame, kind: str, n: int | None = None) -> DataFrame:
    """Top list with 1-based rank and share of all counted commands (percent)."""
    top = top_list(base, kind, n)
    total = base.select(F.count("*")).scalar()
    # ranks are assigned over the (at most n) rows that survived the top-k
    ranked = top.withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(
            F.col("count").desc(), F.col("label").asc())))
    return ranked.select("rank", "label", "count",
                         (F.lit(100.0) * F.col("count") / total).alias("share_pct"))


def hourly_distribution(base: DataFrame, tz: str | None = "UTC") -> DataFrame:
    """Dense 24 rows (hour, count) in the given zone."""
    counts = base.groupBy(F.hour(local_time(F.col("ts_ms"), tz)).alias("hour")).agg(
        F.count("*").alias("count"))
    hours = base.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(counts), "hour", "left").select(
        "hour", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def daily_distribution(base: DataFrame, tz: str | None = "UTC") -> DataFrame:
    """Sparse (day 'yyyy-MM-dd', count) for every day with activity."""
    day = F.date_format(local_time(F.col("ts_ms"), tz), "yyyy-MM-dd")
    return base.groupBy(day.alias("day")).agg(F.count("*").alias("count"))


def activity_heatmap(base: DataFrame, weeks: int = DEFAULT_HEATMAP_WEEKS, as_of: str | None = None,
                     tz: str | None = "UTC") -> DataFrame:
    """Monday-aligned calendar of ``weeks`` weeks ending in the week of ``as_of``.

    ``as_of`` ('yyyy-MM-dd'); None = the latest activity day in ``base``.
    Output: week (0 = oldest), dow (0 = Monday), day, count, level (0-5).
    """
    if weeks < 1:
        raise ValueError("weeks must be at least 1")
    spark = base.sparkSession
    local_day = F.to_date(local_time(F.col("ts_ms"), tz))
    if as_of is None:
        anchor = base.select(F.max(local_day)).scalar()
    else:
        anchor = F.to_date(F.lit(as_of))
    monday = F.date_trunc("week", anchor).cast("date")
    start = F.date_sub(monday, (weeks - 1) * 7)
    grid = spark.range(weeks * 7).select(
        (F.col("id") / 7).cast("int").alias("week"), (F.col("id") % 7).cast("int").alias("dow"))
    grid = grid.withColumn("day", F.date_add(start, F.col("week") * 7 + F.col("dow")))
    # only the calendar's days are counted (range filter on the data)
    counts = (base.withColumn("day", local_day)
              .filter((F.col("day") >= start) & (F.col("day") <= F.date_add(monday, 6)))
              .groupBy("day").agg(F.count("*").alias("count")))
    cells = grid.join(F.broadcast(counts), "day", "left").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))
    return cells.select("week", "dow", F.date_format("day", "yyyy-MM-dd").alias("day"), "count",
                        heat_level(F.col("count")).alias("level"))


def stats_all(base: DataFrame, tz: str | None = "UTC") -> DataFrame:
    """Every grouped statistic in one scan: GROUPING SETS over the five labels.

    Output (dimension, label, count) for programs, categories, dirs, hour, day,
    plus commands; callers take top-k per dimension.
    """
    t = local_time(F.col("ts_ms"), tz)
    rows = base.select(
        F.col("cmd").alias("commands"),
        program_name("cmd").alias("programs"),
        category("cmd").alias("categories"),
        F.when(F.col("cwd") != "", F.col("cwd")).alias("dirs"),
        F.hour(t).cast("string").alias("hour"),
        F.date_format(t, "yyyy-MM-dd").alias("day"))
    dims = ["commands", "programs", "categories", "dirs", "hour", "day"]
    which = None
    for d in dims:
        cond = F.grouping(d) == 0
        which = F.when(cond, F.lit(d)) if which is None else which.when(cond, F.lit(d))
    grouped = rows.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        which.alias("dimension"), F.count("*").alias("count"))
    out = grouped.select("dimension", F.coalesce(*[F.col(d) for d in dims]).alias("label"), "count")
    return out.filter(~((F.col("dimension") == "dirs") & F.col("label").isNull()))
