"""Structured Streaming ingest: latest-per-command state and incremental index.

* ``latest_stream``: the batch ingest aggregation as a streaming aggregation
  (update mode). State is one row per distinct command; use the RocksDB
  state store so it can exceed executor memory.
* ``start_latest``: each micro-batch's changed rows are written under
  ``epoch=<batch id>`` (overwritten on retry, so a lost executor or a replayed
  batch never duplicates rows); ``read_latest`` resolves the newest row per
  hash across epochs. ``compact_latest`` folds epochs into one snapshot.
* ``index_stream``: trigrams of first-seen commands only (streaming
  ``dropDuplicates`` on the content hash), appended by the exactly-once file
  sink. A command's trigram set never changes, so each hash is indexed once.

* ``start_upserts``: the same result without streaming state, on a bucketed store.

Event time comes from the data; an older event arriving late simply loses to
the newer one already in state (``max_by`` ordering), so no watermark is
needed for correctness. A watermark would only bound state and would change
results, so none is set by default.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import command_hash
from ..functions.ngrams import distinct_trigram_strings, pack_gram
from ..operators.ingest import latest_aggregates, normalize_events
from ..schema import META_KEYS
from ..session import checkpoint_path
from ..sources.bucket_store import BucketStore
from ..sources.tool_calls import tool_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def _shuffle_partitions(spark: SparkSession, n: int | None):
    """Fix the number of state partitions a new stream starts with (it is
    frozen in the checkpoint at first start), restoring the session value."""
    if not n:
        yield
        return
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _text_stream(spark: SparkSession, path: str, files_per_batch: int | None):
    reader = spark.readStream.option("lineSep", "\n")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(path)


def line_stream(spark: SparkSession, path: str, cwd: str = "", source: str = "",
                tool: str = "", category: str = "", files_per_batch: int | None = None) -> DataFrame:
    """Streaming line log (one command per line, empty lines skipped, one
    trailing CR stripped) as command events; event time = file modification
    time. Every line of the stream shares cwd and tags, so the order of
    equal-time lines cannot change the result (event_id is constant)."""
    raw = _text_stream(spark, path, files_per_batch)
    line = F.regexp_replace(F.col("value"), "\r$", "")
    return (raw.select(line.alias("cmd"),
                       F.unix_millis(F.col("_metadata.file_modification_time")).alias("ts_ms"),
                       F.lit(0).cast("long").alias("event_id"))
            .filter(F.col("cmd") != "")
            .select("event_id", "cmd", F.lit(cwd).alias("cwd"), "ts_ms", F.lit(source).alias("source"),
                    F.lit(tool).alias("tool"), F.lit(category).alias("category")))


def tool_call_stream(spark: SparkSession, path: str, source: str = "agent",
                     files_per_batch: int | None = None) -> DataFrame:
    """Streaming hook payloads (one JSON object per line) as tagged command
    events, parsed exactly like the batch tool-call source. Event time is the
    file's modification time; equal-time payloads of one command are ordered
    by a hash of the payload (deterministic; the text source has no line
    number to recover file order)."""
    raw = _text_stream(spark, path, files_per_batch)
    df = raw.select(F.col("value").alias("js"),
                    F.unix_millis(F.col("_metadata.file_modification_time")).alias("ts_ms"),
                    F.xxhash64(F.col("value")).alias("event_id"))
    return tool_events(df, json_col="js", source=source)


def latest_stream(events: DataFrame, default_cwd: str | None = None) -> DataFrame:
    """Streaming latest-per-command aggregation (run with outputMode('update'))."""
    ev = normalize_events(events, default_cwd)
    agg = ev.groupBy("cmd").agg(*latest_aggregates())
    return agg.select(command_hash("cmd").alias("hash"), "cmd", "cwd", "ts_ms", *META_KEYS)


def start_latest(events: DataFrame, path: str, checkpoint: str | None = None,
                 available_now: bool = True, state_partitions: int | None = None) -> StreamingQuery:
    spark = events.sparkSession
    use_rocksdb(spark)
    checkpoint = checkpoint or checkpoint_path(spark, "latest")

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch_id}"))

    writer = (latest_stream(events).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).foreachBatch(write_epoch))
    writer = writer.trigger(availableNow=True) if available_now else writer
    with _shuffle_partitions(spark, state_partitions):
        return writer.start()


def start_upserts(events: DataFrame, store: BucketStore, fold_every: int = 16, checkpoint: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Stream events into a bucketed history without any streaming state: what other forms keep in the
    state store is the stored table itself, so nothing grows with the number of commands seen and nothing
    needs a watermark; a command that returns after any time finds its tags and times. Each micro-batch
    is an open epoch; every ``fold_every`` batches the open ones are upserted together. Readers
    (``store.history()``) read the table and the open epochs only.
    """
    spark = events.sparkSession
    checkpoint = checkpoint or checkpoint_path(spark, "upserts")

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        if len([e for e in store.open_epochs() if e <= epoch_id]) >= fold_every:
            store.fold()
        store.append(batch, epoch_id + 1)

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_epoch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Newest row per hash across all written epochs."""
    parts = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/epoch=*")
    cols = ["cmd", "cwd", "ts_ms", *META_KEYS]
    best = parts.groupBy("hash").agg(F.max_by(F.struct(*cols), F.col("epoch")).alias("r"))
    return best.select("hash", *[F.col(f"r.{c}").alias(c) for c in cols])


def compact_latest(spark: SparkSession, path: str, out_path: str) -> None:
    """Write the resolved snapshot to a new location (readers switch to it)."""
    read_latest(spark, path).write.mode("overwrite").parquet(out_path)


def index_stream(events: DataFrame) -> DataFrame:
    """(ngram, hash) rows for commands not seen before (append mode)."""
    ev = normalize_events(events).select("cmd").withColumn("hash", command_hash("cmd"))
    first = ev.dropDuplicates(["hash"])
    windows = first.select(F.explode(distinct_trigram_strings(F.col("cmd"))).alias("_g"), "hash")
    return windows.select(pack_gram("_g").alias("ngram"), "hash")


def start_index(events: DataFrame, path: str, checkpoint: str | None = None,
                available_now: bool = True, state_partitions: int | None = None) -> StreamingQuery:
    spark = events.sparkSession
    use_rocksdb(spark)
    checkpoint = checkpoint or checkpoint_path(spark, "index")
    writer = (index_stream(events).writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    with _shuffle_partitions(spark, state_partitions):
        return writer.start()
