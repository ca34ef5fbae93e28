"""Readers and writers for command logs and the encoded history at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import b64_decode, b64_encode
from ..schema import HISTORY_RAW


def read_lines(spark: SparkSession, path: str, cwd: str = "", source: str = "",
               tool: str = "", category: str = "", ts_ms: int | None = None) -> DataFrame:
    """One command per line; empty lines skipped; one trailing CR stripped.

    Every line gets the same cwd and tags. Lines of one file share ``ts_ms``
    (or the file's modification time when not given), ordered by position.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace(F.col("value"), "\r$", "")
    ts = F.lit(ts_ms) if ts_ms is not None else F.unix_millis(F.col("_metadata.file_modification_time"))
    return raw.select(line.alias("cmd"), ts.cast("long").alias("ts_ms"),
                      F.monotonically_increasing_id().alias("event_id")).filter(
        F.col("cmd") != "").select(
        "event_id", "cmd", F.lit(cwd).alias("cwd"), "ts_ms", F.lit(source).alias("source"),
        F.lit(tool).alias("tool"), F.lit(category).alias("category"))


def encode_history(history: DataFrame) -> DataFrame:
    """History -> stored form: (hash, ts, base64 cmd, base64 cwd)."""
    return history.select("hash", F.col("ts_ms").alias("ts"), b64_encode("cmd").alias("cmd"),
                          b64_encode("cwd").alias("cwd"))


def decode_history(raw: DataFrame) -> DataFrame:
    """Stored form -> (hash, cmd, cwd, ts_ms). Undecodable cmd: row dropped;
    undecodable, NULL or missing cwd: ''."""
    cols = set(raw.columns)
    cwd = b64_decode(F.col("cwd")) if "cwd" in cols else F.lit(None).cast("string")
    return (raw.select("hash", b64_decode(F.col("cmd")).alias("cmd"),
                       F.coalesce(cwd, F.lit("")).alias("cwd"), F.col("ts").alias("ts_ms"))
            .filter(F.col("cmd").isNotNull()))


def read_history_raw(spark: SparkSession, path: str) -> DataFrame:
    """Read stored rows with the full schema: files written before ``cwd``
    existed read it as NULL (the migration's effect)."""
    return spark.read.schema(HISTORY_RAW).parquet(path)


def write_history(history: DataFrame, path: str) -> None:
    """History at rest: partitioned by source tag (the default user scope then
    reads only the untagged partition), sorted by directory and time inside
    files so exact-directory filters skip row groups by min/max statistics.

    Range partitioning on (source, cwd, ts) lets the sampled boundaries split
    a directory holding a third of all rows across many writer tasks."""
    (history.repartitionByRange("source", "cwd", "ts_ms").sortWithinPartitions("cwd", "ts_ms")
     .write.mode("overwrite").partitionBy("source").parquet(path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored history. An empty tag is stored as the default partition
    (read back as NULL) and restored to ''; predicates on ``source`` still
    prune partitions because they reference the partition column only."""
    df = spark.read.parquet(path)
    return df.select("hash", "cmd", "cwd", "ts_ms", F.coalesce(F.col("source"), F.lit("")).alias("source"),
                     "tool", "category")


def write_index(index: DataFrame, path: str) -> None:
    """Trigram index at rest, range-partitioned and sorted by ``ngram`` so a
    lookup of a few trigrams reads only the files / row groups holding them;
    the command's key (``hash``, or ``seq`` of a numbered history) as the second range key
    splits a trigram found in a third of all commands across many files."""
    order = ["ngram", *[c for c in index.columns if c != "ngram"]]
    (index.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").parquet(path))
