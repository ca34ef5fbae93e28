"""Registered queries of the stores that are written batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.category import category
from ..functions.text import program_name
from ..operators import index, sketches, stats
from ..operators.util import materialize
from ..session import checkpoint_path
from ..sources import fixtures
from ..sources.bucket_store import BucketStore
from ..streaming import ingest as streaming
from ..streaming.segments import SegmentedIndex, start_segments
from . import oracle as O
from .registry import EVENTS_BASE, ORACLE, _event_base, events, register

HISTORY_COLUMNS = ["hash", "cmd", "cwd", "ts_ms", "source", "tool", "category"]


@register("upsert_buckets", ORACLE["ingest_latest"])
def upsert_buckets(spark, sf):
    """Three batches that overlap in time, the last one holding the oldest events; equals a full ingest."""
    ev = materialize(fixtures.command_events(events(spark, sf)), "events")
    store = BucketStore(spark, checkpoint_path(spark, "bucket-store"), buckets=16)
    store.upsert(ev.filter("event_id % 3 = 1"), 1)
    store.upsert(ev.filter("event_id % 3 = 2"), 2)
    store.upsert(ev.filter("event_id % 3 = 0"), 3)
    return store.history().select(*HISTORY_COLUMNS)


_GONE = O.category_sql(O.program_sql()) + " = 'containers'"
_COLS = ", ".join(HISTORY_COLUMNS)


@register("prune_tombstones", "WITH " + O.COMMAND_EVENTS + "," + O.category_map_cte() + ","
          + O.history_cte("(SELECT * FROM command_events WHERE event_id % 2 = 0)", "older").lstrip() + ","
          + O.history_cte("(SELECT * FROM command_events WHERE event_id % 4 = 1)", "newer").lstrip() + ","
          + O.history_cte("(SELECT * FROM command_events WHERE event_id % 2 = 0 OR event_id % 4 = 1)", "both_").lstrip() + f"""
, left_ AS (SELECT * FROM older WHERE NOT ({_GONE})),
idx AS ({O.trigram_rows("left_", "hash", "cmd")}),
seen_again AS (
  SELECT b.hash, b.cmd, CASE WHEN l.hash IS NULL THEN n.cwd ELSE b.cwd END AS cwd, CASE WHEN l.hash IS NULL THEN n.ts_ms ELSE b.ts_ms END AS ts_ms,
         b.source, b.tool, b.category
  FROM both_ b LEFT JOIN left_ l USING (hash) LEFT JOIN newer n USING (hash) WHERE l.hash IS NOT NULL OR n.hash IS NOT NULL)
SELECT 'before compaction' AS stage, {_COLS} FROM left_ UNION ALL
SELECT 'after compaction', {_COLS} FROM left_ UNION ALL
SELECT 'index ' || (ngram % 7), hash, '', '', count(*), '', '', '' FROM idx GROUP BY ngram % 7, hash UNION ALL
SELECT 'seen again', {_COLS} FROM seen_again""")
def prune_tombstones(spark, sf):
    """A prune by tombstones, read before and after compaction, its effect on a stored index, and the pruned
    commands seen again: with their old tags, but the new directory and time."""
    ev = materialize(fixtures.command_events(events(spark, sf)), "events")
    store = BucketStore(spark, checkpoint_path(spark, "bucket-store"), buckets=16)
    store.upsert(ev.filter("event_id % 2 = 0"), 1)
    idx = materialize(index.build_index(store.history()), "index")
    store.prune(store.history().filter(category("cmd") == "containers").select("hash"), 2)

    def stage(name):
        return materialize(store.history().select(F.lit(name).alias("stage"), *HISTORY_COLUMNS), "stage")
    before = stage("before compaction")
    grams = materialize(store.live_index(idx).groupBy(F.concat(F.lit("index "), (F.col("ngram") % 7).cast("string")).alias("stage"), "hash").agg(
        F.count(F.lit(1)).alias("ts_ms")).select("stage", "hash", *[F.lit("").alias(c) for c in ("cmd", "cwd")], "ts_ms",
                                                 *[F.lit("").alias(c) for c in ("source", "tool", "category")]), "stage")
    store.compact()
    after = stage("after compaction")
    store.upsert(ev.filter("event_id % 4 = 1"), 3)
    return before.unionByName(after).unionByName(grams).unionByName(stage("seen again"))


@register("stream_index_segments", ORACLE["ngram_index"])
def stream_index_segments(spark, sf):
    """Ten micro-batches into a segmented index, read back from its live segments."""
    path = checkpoint_path(spark, "event-files")
    ev = fixtures.command_events(events(spark, sf))
    ev.repartition(10, "event_id").write.parquet(path)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    idx = SegmentedIndex(spark, checkpoint_path(spark, "segments"))
    start_segments(stream, idx, state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return idx.read()


@register("stream_upserts", ORACLE["ingest_latest"])
def stream_upserts(spark, sf):
    """Twelve micro-batches, commands returning in many of them, without streaming state; read with open epochs left."""
    path = checkpoint_path(spark, "event-files")
    ev = fixtures.command_events(events(spark, sf))
    ev.repartition(12, "event_id").write.parquet(path)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = BucketStore(spark, checkpoint_path(spark, "bucket-store"), buckets=16)
    streaming.start_upserts(stream, store, fold_every=5).awaitTermination()
    return store.history().select(*HISTORY_COLUMNS)


# --------------------------------------------------------------------------- statistics from kept sketches
_KINDS = {"programs": (O.program_sql(), 15, "TRUE"), "dirs": ("cwd", 10, "cwd <> ''"), "commands": ("cmd", 15, "TRUE")}


@register("top_lists_sketched", "WITH " + O.COMMAND_EVENTS + "," + EVENTS_BASE + " UNION ALL ".join(f"""
SELECT '{kind}' AS dimension, label, count FROM (
  SELECT label, count FROM (SELECT {label} AS label, count(*) AS count FROM base WHERE {where} GROUP BY 1)
  ORDER BY count DESC, label LIMIT {n})""" for kind, (label, n, where) in _KINDS.items()))
def top_lists_sketched(spark, sf):
    """Exact top lists of the raw events from sketches kept per day, with a recount of their candidates."""
    base = materialize(_event_base(spark, sf), "events")
    out = None
    for kind, (_, n, _) in _KINDS.items():
        rows = base.filter("cwd <> ''") if kind == "dirs" else base
        label = stats.label_column(kind)
        kept = materialize(sketches.frequent_sketches(rows, label, F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")), "day-sketches")
        top = sketches.top_list_sketched(rows, label, n, kept).select(F.lit(kind).alias("dimension"), "label", "count")
        out = top if out is None else out.unionByName(top)
    return out


_RANGES = [("first days", "2024-01-01", "2024-01-03"), ("second week", "2024-01-08", "2024-01-14"), ("month", "2024-01-01", "2024-01-31"),
           ("a day", "2024-01-20", "2024-01-20")]


@register("distinct_sketched", "WITH " + O.COMMAND_EVENTS + "," + EVENTS_BASE + f""",
ranges(name, a, b) AS (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _RANGES)})
SELECT name, count(*) AS n, count(DISTINCT cmd) AS exact_commands, count(DISTINCT {O.program_sql()}) AS exact_programs, TRUE AS within_bound
FROM ranges JOIN base ON CAST(make_timestamp(ts_ms * 1000) AS DATE) BETWEEN a AND b GROUP BY name""")
def distinct_sketched(spark, sf):
    """Distinct commands and programs of date ranges from sketches kept per day and directory: rows and exact
    counts of each range, and whether both estimates are within 5 % (three standard errors) and one."""
    base = materialize(_event_base(spark, sf), "events")
    kept = materialize(sketches.distinct_sketches(base), "distinct-sketches")
    ranges = spark.createDataFrame(_RANGES, "name string, from_day string, to_day string")
    estimated = sketches.distinct_in_ranges(kept, ranges)
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")
    days = ranges.select("name", F.explode(F.sequence(F.to_date("from_day"), F.to_date("to_day"))).alias("_d"))
    exact = base.withColumn("day", day).join(days.select("name", F.date_format("_d", "yyyy-MM-dd").alias("day")), "day").groupBy("name").agg(
        F.count_distinct("cmd").alias("exact_commands"), F.count_distinct(program_name("cmd")).alias("exact_programs"))

    def within(estimate, count):
        return F.abs(F.col(estimate) - F.col(count)) <= F.col(count) * 0.05 + 1
    return estimated.join(exact, "name").select(
        "name", "n", "exact_commands", "exact_programs",
        (within("unique_commands", "exact_commands") & within("unique_programs", "exact_programs")).alias("within_bound"))


# --------------------------------------------------------------------------- many phrases
_PHRASES = """
src AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 5 = 0),
phrases AS (SELECT doc_id AS phrase_id, w[4] || ' x' || substr(w[5], 2) || ' ' || w[6] AS phrase FROM src WHERE len(w) >= 6),
prepared AS (
  SELECT phrase_id, lower(trim(phrase)) AS p, list_filter(string_split_regex(lower(trim(phrase)), '\\s+'), lambda x: x <> '') AS words FROM phrases),
ready AS (SELECT phrase_id, p, words, list_transform(words, lambda x: greatest(1, strlen(x) // 5)) AS thr, len(words) AS n FROM prepared),
toks AS (
  SELECT doc_id, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '[ \\t/=:,;|&()\\[\\]{}<>]+'), lambda x: x <> '') AS toks
  FROM documents),
known AS (
  SELECT DISTINCT token, word FROM (SELECT DISTINCT unnest(toks) AS token FROM toks), (SELECT DISTINCT unnest(words) AS word FROM ready)
  WHERE contains(token, word) OR levenshtein(token, word) <= greatest(1, strlen(word) // 5)),
near AS (SELECT token, list(word) AS near FROM known GROUP BY token),
marked AS (
  SELECT doc_id, list(coalesce(near, []) ORDER BY i) AS seen FROM (
    SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM toks) LEFT JOIN near USING (token)
  WHERE near IS NOT NULL GROUP BY doc_id),
tested AS (
  SELECT t.doc_id, r.phrase_id, contains(t.t, r.p) AS exact,
         coalesce(list_reduce(m.seen, lambda k, s: CASE WHEN k < r.n AND list_contains(s, r.words[k + 1]) THEN k + 1 ELSE k END, 0) = r.n, FALSE) AS fuzzy
  FROM toks t LEFT JOIN marked m USING (doc_id), ready r)"""


@register("phrases_documents", "WITH " + _PHRASES + " SELECT doc_id, phrase_id, exact FROM tested WHERE exact OR fuzzy")
def phrases_documents(spark, sf):
    """A phrase of three words, one mistyped, of every fifth document, looked for in all documents at once."""
    from ..operators.phrase_dictionary import match_phrases

    d = fixtures.load(spark, sf, "documents").select("doc_id", "text")
    w = F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")
    mine = d.filter("doc_id % 5 = 0").select("doc_id", w.alias("w")).filter(F.size("w") >= 6).select(
        "doc_id", F.concat(F.get("w", F.lit(3)), F.lit(" x"), F.substr(F.get("w", F.lit(4)), F.lit(2), F.lit(1000)), F.lit(" "), F.get("w", F.lit(5))).alias("p"))
    # the user's list of phrases
    return match_phrases(d, [(r.doc_id, r.p) for r in mine.collect()], "doc_id", "text")
