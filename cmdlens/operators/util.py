"""Small planning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Largest limit that one task takes as a top-k; beyond it, positions come from a distributed order.
TOP_K_REACH = 100_000


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` once, as Parquet, to the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: inputs read by several branches
    of one plan keep column pruning and filter pushdown, and a lost executor
    costs a re-read, not a recomputation of the whole lineage.
    """
    from ..session import checkpoint_path

    spark = df.sparkSession
    path = checkpoint_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, text_col: str, part_bytes: int = 16_000_000, *by: str) -> DataFrame:
    """``rows`` dealt evenly (or by the columns ``by``) for work per byte of ``text_col``: a table in few row groups would be few tasks."""
    size = rows.select(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes)), *by)


def with_position(df: DataFrame, order: list[Column], name: str = "pos", tag: str = "ordered") -> DataFrame:
    """Add the 1-based position of each row under ``order`` without a
    single-partition window: rows are range-partitioned and written once, the
    partitions' sizes give each its offset, and ranks are taken inside them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), tag)
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (parted.withColumn("_rank", F.row_number().over(inside)).join(offsets, "_part")
            .withColumn(name, F.col("_offset") + F.col("_rank")).drop("_part", "_rank", "_offset"))
