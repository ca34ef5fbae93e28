"""Latest-per-command upsert with sticky tags (batch form; streaming reuses it).

``INSERT OR REPLACE`` keyed by content hash becomes one aggregation keyed by the
command text (sort-based, as its buffers hold strings): partial (map-side) aggregation collapses repeats of a hot
command before the shuffle, so a command that is a third of all events costs
one row per map task. SHA-256 is computed once per distinct command, after the
aggregation, not once per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import command_hash
from ..schema import META_KEYS


def _order() -> Column:
    # event time first, arrival id breaks ties: the later event wins
    return F.struct(F.col("ts_ms"), F.col("event_id"))


def _sticky(col: str) -> Column:
    """Latest non-empty value: empty values never replace a tag."""
    c = F.col(col)
    return F.coalesce(F.max_by(c, F.when(c != "", _order())), F.lit("")).alias(col)


def latest_aggregates() -> list[Column]:
    return [
        F.max("ts_ms").alias("ts_ms"),
        F.max_by(F.col("cwd"), _order()).alias("cwd"),
        *[_sticky(k) for k in META_KEYS],
    ]


def normalize_events(events: DataFrame, default_cwd: str | None = None) -> DataFrame:
    """Fill optional columns, default the working directory, drop null commands."""
    cols = set(events.columns)
    ev = events
    for k in META_KEYS:
        if k not in cols:
            ev = ev.withColumn(k, F.lit(""))
    if "event_id" not in cols:
        ev = ev.withColumn("event_id", F.lit(0).cast("long"))
    cwd = F.coalesce(F.col("cwd"), F.lit("")) if "cwd" in cols else F.lit("")
    if default_cwd:
        cwd = F.coalesce(F.nullif(cwd, F.lit("")), F.lit(default_cwd))
    return ev.filter(F.col("cmd").isNotNull()).select(
        "event_id", "cmd", cwd.alias("cwd"), "ts_ms",
        *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in META_KEYS])


def _tag_at(col: str) -> Column:
    """When a tag was last set, as (ts_ms, event_id); NULL if never."""
    return F.max(F.when(F.col(col) != "", _order())).alias(f"{col}_at")


def ingest(events: DataFrame, default_cwd: str | None = None, prior_meta: DataFrame | None = None,
           with_order: bool = False) -> DataFrame:
    """Events (cmd, cwd, ts_ms, event_id, tags) -> history, one row per command.

    Latest ``ts_ms`` and latest ``cwd`` win; each tag keeps its latest
    non-empty value. ``prior_meta`` (hash, key, value): metadata kept from an
    earlier history, e.g. through a prune; it fills tags that no event sets.
    ``with_order``: also return when the row and each tag were set (``row_at``,
    ``source_at``, ...), which lets batches that overlap in time be merged.
    """
    ev = normalize_events(events, default_cwd)
    order = [F.max(_order()).alias("row_at"), *[_tag_at(k) for k in META_KEYS]] if with_order else []
    latest = ev.groupBy("cmd").agg(*latest_aggregates(), *order)
    out = latest.select(command_hash("cmd").alias("hash"), "cmd", "cwd", "ts_ms", *META_KEYS,
                        *(["row_at", *[f"{k}_at" for k in META_KEYS]] if with_order else []))
    return out if prior_meta is None else apply_prior_meta(out, prior_meta)


def apply_prior_meta(history: DataFrame, meta: DataFrame) -> DataFrame:
    """Fill empty tags from kept metadata rows (hash, key, value)."""
    kept = meta.groupBy("hash").agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_kept_{k}") for k in META_KEYS])
    filled = history.join(kept, "hash", "left")
    for k in META_KEYS:
        filled = filled.withColumn(k, F.when(F.col(k) != "", F.col(k)).otherwise(
            F.coalesce(F.col(f"_kept_{k}"), F.lit(""))))
    return filled.select(*history.columns)


def merge_history(current: DataFrame, updates: DataFrame, prior_meta: DataFrame | None = None) -> DataFrame:
    """Upsert already-ingested rows into an existing history (same rules).

    Where both inputs carry order columns (``ingest(..., with_order=True)``), each
    tag is ordered by when it was set and batches may overlap in time; they are
    kept in the result. Without them a tag counts as set at its row's ``ts_ms``,
    ``updates`` must hold later events only, and a command whose update is older
    than its stored row is refused with an error when the result is computed.
    """
    ordered = "row_at" in current.columns and "row_at" in updates.columns
    cols = ["hash", "cmd", "cwd", "ts_ms", *META_KEYS]
    if ordered:
        marks = ["row_at", *[f"{k}_at" for k in META_KEYS]]
        both = current.select(*cols, *marks).unionByName(updates.select(*cols, *marks))
        merged = both.groupBy("hash").agg(
            F.any_value("cmd").alias("cmd"), F.max_by("cwd", "row_at").alias("cwd"), F.max("ts_ms").alias("ts_ms"),
            *[F.coalesce(F.max_by(k, f"{k}_at"), F.lit("")).alias(k) for k in META_KEYS],
            *[F.max(m).alias(m) for m in marks]).select(*cols, *marks)
    else:
        both = current.select(*cols).withColumn("event_id", F.lit(0).cast("long")).unionByName(
            updates.select(*cols).withColumn("event_id", F.lit(1).cast("long")))
        stored, update = (F.when(F.col("event_id") == i, F.col("ts_ms")) for i in (0, 1))
        late = F.assert_true(F.coalesce(F.max(stored) <= F.min(update), F.lit(True)),
                             "late update: merge batches made with with_order=True").alias("_late")
        merged = both.groupBy("hash").agg(F.any_value("cmd").alias("cmd"), *latest_aggregates(), late)
        # assert_true gives null where it holds; the filter keeps it in the plan
        merged = merged.filter(F.col("_late").isNull()).select(*cols)
    return merged if prior_meta is None else apply_prior_meta(merged, prior_meta)


def meta_table(history: DataFrame) -> DataFrame:
    """Long (hash, key, value) metadata rows; empty values are not stored."""
    stacked = history.select(
        "hash",
        F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in META_KEYS]),
                                    F.array(*[F.col(k) for k in META_KEYS]))).alias("key", "value"))
    return stacked.filter(F.col("value") != "")


def meta_map(history: DataFrame) -> DataFrame:
    """History with tags folded into one ``meta`` map (no empty entries)."""
    m = F.map_filter(F.create_map(*[x for k in META_KEYS for x in (F.lit(k), F.col(k))]),
                     lambda k, v: v != "")
    return history.select("hash", "cmd", "cwd", "ts_ms", "source", m.alias("meta"))


def build_meta(source: Column | str, tool: Column | str, category: Column | str) -> Column:
    """map<string,string> of the non-empty tags."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    return F.map_filter(
        F.create_map(F.lit("source"), c(source), F.lit("tool"), c(tool),
                     F.lit("category"), c(category)),
        lambda k, v: v.isNotNull() & (v != ""))
