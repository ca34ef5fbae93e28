"""A trigram index that grows by micro-batches and stays in few, sorted files.

Each micro-batch writes its rows as a *segment*, range-partitioned and sorted by
trigram like the batch index. Once ``fanout`` segments of a level exist they are
merged into one of the next level, so a row is rewritten once per level and the
number of live segments is at most ``fanout - 1`` per level, whatever the number of
batches. A lookup of a few trigrams skips the row groups whose bounds exclude them,
in every segment.

Which segments are live is written last, as the batch's *manifest*. A batch that
fails leaves the manifest before it in force, and is written again under the same
names; a batch repeated after its manifest changes nothing. Files of the manifest
before stay until the next batch, for readers that started with it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_path
from .ingest import _shuffle_partitions, index_stream, use_rocksdb

FANOUT = 4
ROWS_PER_FILE = 1_000_000   # a file is sorted by one task
_INDEX = "ngram int, hash string"


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.path, self.fanout, self.rows_per_file = spark, path.rstrip("/"), fanout, rows_per_file

    def _listed(self, name: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def _complete(self, folder: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifests(self) -> list[int]:
        """Epochs whose manifest is complete, in order."""
        return sorted(int(n.split("=")[1]) for n in self._listed("manifests") if self._complete(f"manifests/{n}"))

    def live(self, epoch: int | None = None) -> list[tuple[str, int, int]]:
        """(segment, level, rows) of the segments live at an epoch (the newest by default)."""
        epochs = self.manifests()
        if not epochs:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifests/epoch={epochs[-1] if epoch is None else epoch}").collect()
        return sorted((r.segment, r.level, r.n_rows) for r in rows)

    def read(self) -> DataFrame:
        """(ngram, hash) of all live segments."""
        paths = [f"{self.path}/segments/{s}" for s, _, _ in self.live()]
        return self.spark.read.schema(_INDEX).parquet(*paths) if paths else self.spark.createDataFrame([], _INDEX)

    def _write(self, rows: DataFrame, name: str, n_rows: int) -> None:
        files = max(1, math.ceil(n_rows / self.rows_per_file))
        (rows.repartitionByRange(files, "ngram", "hash").sortWithinPartitions("ngram", "hash")
         .write.mode("overwrite").parquet(f"{self.path}/segments/{name}"))

    def append(self, rows: DataFrame, epoch: int) -> None:
        """Add a micro-batch's rows as a segment, merge full levels, then publish the manifest."""
        epochs = self.manifests()
        if epoch in epochs:
            return
        before = self.live()
        rows = rows.persist()
        try:
            n = rows.count()
            live = list(before)
            if n:
                self._write(rows, f"l0-e{epoch}", n)
                live.append((f"l0-e{epoch}", 0, n))
        finally:
            rows.unpersist()
        level = 0
        while sum(at == level for _, at, _ in live) >= self.fanout:
            full = [x for x in live if x[1] == level]
            name, n = f"l{level + 1}-e{epoch}", sum(x[2] for x in full)
            self._write(self.spark.read.schema(_INDEX).parquet(*[f"{self.path}/segments/{x[0]}" for x in full]), name, n)
            live = [x for x in live if x[1] != level] + [(name, level + 1, n)]
            level += 1
        manifest = self.spark.createDataFrame(live, "segment string, level int, n_rows long")  # a few rows
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/epoch={epoch}")
        self._clean({s for s, _, _ in before} | {s for s, _, _ in live}, {epoch, *epochs[-1:]})

    def _clean(self, segments: set[str], epochs: set[int]) -> None:
        for name in self._listed("segments"):
            if name not in segments:
                self._delete(f"segments/{name}")
        for name in self._listed("manifests"):
            if int(name.split("=")[1]) not in epochs:
                self._delete(f"manifests/{name}")

    def _delete(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def start_segments(events: DataFrame, index: SegmentedIndex, checkpoint: str | None = None, available_now: bool = True,
                   state_partitions: int | None = None) -> StreamingQuery:
    """Stream events into a segmented index; each command is indexed at its first appearance."""
    spark = events.sparkSession
    use_rocksdb(spark)
    checkpoint = checkpoint or checkpoint_path(spark, "index-segments")
    writer = (index_stream(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, epoch: index.append(batch, epoch)))
    writer = writer.trigger(availableNow=True) if available_now else writer
    with _shuffle_partitions(spark, state_partitions):
        return writer.start()
