"""Schemas of the data model (events in, history / index / annotations at rest)."""

from pyspark.sql import types as T

# One observed command (the ingest input). ``event_id`` breaks ts ties.
COMMAND_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("cmd", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("category", T.StringType()),
])

# One row per distinct command at its latest occurrence, tags folded in.
HISTORY = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("cmd", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("category", T.StringType()),
])

# Encoded history as stored at rest (base64 cmd / cwd; cwd may be missing).
HISTORY_RAW = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("cmd", T.StringType()),
    T.StructField("cwd", T.StringType()),
])

# Inverted trigram index.
NGRAM_INDEX = T.StructType([
    T.StructField("ngram", T.IntegerType()),
    T.StructField("hash", T.StringType()),
])

ANNOTATIONS = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("type", T.IntegerType()),
    T.StructField("desc", T.StringType()),
])

META = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

# Search result rows.
HITS_COLUMNS = ["hash", "cmd", "cwd", "ts_ms", "annotation_type", "source"]

META_KEYS = ("source", "tool", "category")
