"""A stored history that is written batch by batch: upserts and prunes touch only their buckets.

Rows lie in buckets by the first characters of their content hash (uniform, so a
hot directory or tag cannot fill one). An *upsert* rewrites the buckets its batch
falls into, by dynamic partition overwrite; the stored rows of these buckets stream
past the batch and are not exchanged when the batch is small. A *prune* writes the
deleted hashes as tombstones beside the table; readers leave the rows out, and
:meth:`BucketStore.compact` folds the tombstones in later. A pruned row is kept as
its tags alone (without command, directory or time), so a command seen again gets
its old tags back.

Small batches, as a stream brings them, need not rewrite anything: :meth:`BucketStore.append`
keeps a batch as an *open epoch* beside the table, readers merge the open epochs with
the rows, and :meth:`BucketStore.fold` upserts them together.

Every write carries an ``epoch``, a number that grows with each (a batch id). A
tombstone deletes rows of earlier epochs only, so a command seen again after its
prune is visible at once, and a write that is repeated after a failure changes
nothing: a batch already merged merges to the same rows. A store has one writer.

Rows keep when they and each of their tags were set, so batches may arrive late
and overlap in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import ingest, merge_history
from ..operators.util import materialize
from ..schema import META_KEYS

BUCKETS = 256
_AT = "struct<ts_ms:bigint,event_id:bigint>"
_COLUMNS = ["hash", "cmd", "cwd", "ts_ms", *META_KEYS]
_MARKS = ["row_at", *[f"{k}_at" for k in META_KEYS]]


class BucketStore:
    """``path/rows/bucket=<n>``, ``path/tombstones/bucket=<n>`` and ``path/open/epoch=<n>``; ``buckets`` is
    fixed for the life of a store."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ---------------------------------------------------------------- reading
    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All stored rows (pruned ones too) of some buckets; a list of buckets prunes partitions."""
        return self._read("rows", self._row_schema(), buckets)

    @staticmethod
    def _row_schema(with_epoch: bool = True) -> str:
        return ("hash string, cmd string, cwd string, ts_ms long, " + ", ".join(f"{k} string" for k in META_KEYS) + ", "
                + ", ".join(f"{m} {_AT}" for m in _MARKS) + (", epoch long, bucket int" if with_epoch else ""))

    def tombstones(self, buckets: list[int] | None = None) -> DataFrame:
        """The latest tombstone of each hash: hash, gone_at (epoch), bucket."""
        t = self._read("tombstones", "hash string, epoch long, bucket int", buckets)
        return t.groupBy("hash", "bucket").agg(F.max("epoch").alias("gone_at"))

    def history(self) -> DataFrame:
        """The visible rows, one per command: the table merged with the open epochs."""
        seen = self._seen(self.rows(), self.tombstones())
        epochs = self.open_epochs()
        if not epochs:
            return seen.filter(~F.col("_gone")).select(*_COLUMNS)
        batch = self._opened(epochs)
        known = seen.select("hash").join(batch.select("hash"), "hash", "left_semi")
        return self._merged(seen, batch, known, epochs[-1]).filter(F.col("cmd").isNotNull()).select(*_COLUMNS)

    def open_epochs(self) -> list[int]:
        fs, p = self._fs("open")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p) if fs.exists(self._fs(f"open/{x.getPath().getName()}/_SUCCESS")[1])]
        return sorted(int(n.split("=")[1]) for n in names)

    def _opened(self, epochs: list[int]) -> DataFrame:
        """The open epochs' rows as one batch: one row per command, tags by when they were set."""
        parts = self.spark.read.schema(self._row_schema(with_epoch=False)).parquet(*[f"{self.path}/open/epoch={e}" for e in epochs])
        none = parts.limit(0)
        return self._bucketed(merge_history(none, parts))

    def live_index(self, index: DataFrame) -> DataFrame:
        """Index rows (.., hash) of commands that are not pruned. Only tombstones meet the index: the
        hashes deleted and not seen since."""
        gone = self.tombstones()
        again = self.rows().select("hash", "epoch").join(gone, "hash").filter(F.col("epoch") >= F.col("gone_at")).select("hash")
        return index.join(gone.select("hash").join(again, "hash", "left_anti"), "hash", "left_anti")

    # ---------------------------------------------------------------- writing
    def upsert(self, events: DataFrame, epoch: int) -> list[int]:
        """Merge a batch of events; returns the buckets that were rewritten."""
        return self._upsert(self._bucketed(ingest(events, with_order=True)), epoch)

    def append(self, events: DataFrame, epoch: int) -> None:
        """Keep a batch of events as an open epoch; a repeated epoch replaces itself."""
        ingest(events, with_order=True).write.mode("overwrite").parquet(f"{self.path}/open/epoch={epoch}")

    def fold(self) -> list[int]:
        """Upsert the open epochs together; returns the buckets that were rewritten. Repeated after a
        failure it merges the same rows again."""
        epochs = self.open_epochs()
        if not epochs:
            return []
        touched = self._upsert(self._opened(epochs), epochs[-1])
        for e in epochs:
            fs, p = self._fs(f"open/epoch={e}")
            fs.delete(p, True)
        return touched

    def _upsert(self, batch: DataFrame, epoch: int) -> list[int]:
        batch = materialize(batch, "upsert-batch")
        touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        stored = self._seen(self.rows(touched), self.tombstones(touched))
        known = materialize(stored.select("hash").join(batch.select("hash"), "hash", "left_semi"), "upsert-known")
        self._overwrite(self._merged(stored, batch, known, epoch))
        self._drop(touched, "tombstones")
        return touched

    def prune(self, hashes: DataFrame, epoch: int) -> None:
        """Delete the commands of these hashes: tombstones are added, no row is rewritten (open epochs are
        folded first, so that a tombstone is newer than all it deletes)."""
        hashes = materialize(hashes.select("hash").distinct(), "pruned") if self.open_epochs() else hashes
        self.fold()
        t = self._bucketed(hashes.select("hash").distinct()).withColumn("epoch", F.lit(epoch).cast("long"))
        # one small file per bucket and prune; a repeated write adds equal tombstones
        t.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/tombstones")

    def compact(self) -> list[int]:
        """Fold tombstones in: rewrites the buckets that hold any, returns them."""
        touched = sorted(r.bucket for r in self._read("tombstones", "hash string, bucket int", None).select("bucket").distinct().collect())
        if not touched:
            return []
        seen = self._seen(self.rows(touched), self.tombstones(touched))
        folded = [F.when(~F.col("_gone"), F.col(c)).alias(c) if c in ("cmd", "cwd", "ts_ms", "row_at") else F.col(c)
                  for c in [*_COLUMNS, *_MARKS]]
        # a folded row without tags has nothing left to keep
        keep = F.col("cmd").isNotNull()
        for k in META_KEYS:
            keep = keep | (F.col(k) != "")
        out = seen.select(*folded, "epoch", "bucket").filter(keep)
        left = {r.bucket for r in out.select("bucket").distinct().collect()}
        self._overwrite(out)
        # buckets without rows are not in the overwrite; their rows go before the tombstones that hide them
        self._drop([b for b in touched if b not in left], "rows")
        self._drop(touched, "tombstones")
        return touched

    # ---------------------------------------------------------------- parts
    def _bucketed(self, df: DataFrame) -> DataFrame:
        at = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % self.buckets
        return df.withColumn("bucket", at.cast("int"))

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, name: str, schema: str, buckets: list[int] | None) -> DataFrame:
        fs, p = self._fs(name)
        if not fs.exists(p):
            # a false filter is seen by the optimiser: joins with the empty table vanish from the plan
            empty = T.StructType.fromDDL(schema)
            return self.spark.range(1).filter(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in empty])
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if buckets is None else df.filter(F.col("bucket").isin(buckets))

    @staticmethod
    def _seen(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
        """Rows with ``_gone``: deleted by a tombstone, or already folded to their tags."""
        t = tombstones.select("hash", "gone_at")
        return rows.join(t, "hash", "left").withColumn(
            "_gone", F.col("cmd").isNull() | F.coalesce(F.col("gone_at") > F.col("epoch"), F.lit(False))).drop("gone_at")

    def _merged(self, stored: DataFrame, batch: DataFrame, known: DataFrame, epoch: int) -> DataFrame:
        """Stored rows updated by the batch, and the batch's rows that are not ``known``."""
        new = batch.join(known, "hash", "left_anti").withColumn("epoch", F.lit(epoch).cast("long"))
        b = batch.select("hash", *[F.col(c).alias(f"_{c}") for c in [*_COLUMNS[1:], *_MARKS]])
        merged = stored.join(b, "hash", "left").select(*self._merged_columns(epoch))
        return merged.unionByName(new.select(*merged.columns))

    @staticmethod
    def _merged_columns(epoch: int) -> list[Column]:
        hit, gone = F.col("_cmd").isNotNull(), F.col("_gone")

        def place(c, newer):
            return F.when(hit & newer, F.col(f"_{c}")).when(~gone, F.col(c)).alias(c)
        later = gone | (F.col("_row_at") > F.col("row_at"))

        def tag(c):
            newer = F.col(f"_{c}_at").isNotNull() & (F.col(f"{c}_at").isNull() | (F.col(f"_{c}_at") > F.col(f"{c}_at")))
            return [F.when(newer, F.col(f"_{c}")).otherwise(F.col(c)).alias(c),
                    F.when(newer, F.col(f"_{c}_at")).otherwise(F.col(f"{c}_at")).alias(f"{c}_at")]
        tags = [tag(c) for c in META_KEYS]
        return ["hash", place("cmd", gone), place("cwd", later), place("ts_ms", later), *[t[0] for t in tags],
                place("row_at", later), *[t[1] for t in tags],
                F.when(hit, F.lit(epoch).cast("long")).otherwise(F.col("epoch")).alias("epoch"), "bucket"]

    def _overwrite(self, rows: DataFrame) -> None:
        """Replace exactly the buckets that ``rows`` holds (new files appear when the job commits).
        One task per bucket: buckets are even, as they go by content hash."""
        (rows.repartition("bucket").sortWithinPartitions("bucket", "hash").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows"))

    def _drop(self, buckets: list[int], name: str) -> None:
        """Remove some buckets' files. Tombstones go last; should that step be lost, they are harmless: rows
        written since have a later epoch, and folded rows stay folded."""
        for b in buckets:
            fs, p = self._fs(f"{name}/bucket={b}")
            if fs.exists(p):
                fs.delete(p, True)
