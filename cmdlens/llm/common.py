"""Helpers shared by the training-data operators.

A *text key* names a row of ``documents`` by content: operators that decide on
rows hand their decisions back on it, so null and repeated ``doc_id`` values
need no special path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path

# ASCII white space of the word and normalisation rules: tab, LF, VT, FF, CR, space.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded by bytes: few long texts or many narrow rows each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table."""
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read; the job runs the
    plan exactly once (``checkpoint()`` would run its last stage twice).
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that no later plan reads."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    folder = files[0].rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def per_worker(key: tuple, make):
    """One object per Python worker process and key: a memo filled by one task serves the next."""
    import sys
    import types

    box = sys.modules.setdefault("_cmdlens_worker", types.ModuleType("_cmdlens_worker"))
    if key not in box.__dict__:
        box.__dict__[key] = make()
    return box.__dict__[key]


def text_key(doc_id: Column, text: Column) -> Column:
    """Non-null string naming a row by its ``doc_id`` and text (128 hash bits and the length)."""
    return F.concat_ws(
        ":", F.coalesce(doc_id.cast("string"), F.lit("-")),
        F.hex(F.xxhash64(text)), F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16),
        F.coalesce(F.octet_length(text).cast("string"), F.lit("-")))


def keep_rows(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text key is in ``keepers._key``; of identical rows one stays.

    One exchange of the documents: the join and the removal of repeats share it. All columns
    stay, whatever they are called.
    """
    name = free_name(docs, "_row_key")
    keyed = docs.withColumn(name, text_key(F.col("doc_id"), F.col("text")))
    keys = keepers.select(F.col("_key").alias(name)).distinct()
    return keyed.join(keys, name, "left_semi").dropDuplicates([name]).drop(name)


def bucket_count(rows: int, per_bucket: int) -> int:
    """Number of buckets that keeps an average bucket at ``per_bucket`` rows."""
    return max(1, math.ceil(rows / per_bucket))


def key_runs(batches: Iterator[pa.RecordBatch], shift: int = 0) -> Iterator[list[np.ndarray]]:
    """Columns of sorted Arrow batches as numpy arrays, regrouped so that rows equal
    in the first column (without its last ``shift`` bits) come together."""
    def same(x, i, y, j):
        return x[0][i] >> shift == y[0][j] >> shift

    hold: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        hold.append(cols)
        if same(cols, 0, cols, -1) and same(hold[0], 0, cols, 0):
            continue
        cols = [np.concatenate(c) for c in zip(*hold)]
        key = cols[0] >> shift
        last = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1
        yield [c[:last] for c in cols]
        hold = [[c[last:] for c in cols]]
    if hold:
        yield [np.concatenate(c) for c in zip(*hold)]
