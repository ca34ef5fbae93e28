"""Short unambiguous hash prefixes ("hashlets").

Minimal length: the smallest L in 4..64 at which all prefixes are distinct is
``max(LCP(h, next h) + 1)`` over hashes in sorted order, clamped to 4..64.
Pairs whose first four characters differ can never push the answer above the
floor of 4, so the adjacency window is partitioned by the 4-character prefix
and runs in parallel (SHA-256 prefixes are uniform). Repeated hashes (answer
64) are detected by a partially-aggregated count first, so a hash repeated in
a third of all rows never reaches a window partition.

Prefix resolution classifies many prefixes at once: empty, invalid (non-hex),
not_found, ambiguous or found (with the command).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize

MIN_LEN = 4
MAX_LEN = 64
# Rows of one sorting task: its memory stays the same for any history.
ROWS_PER_TASK = 200_000


def _lcp(a, b):
    """Length of the common prefix of two hex strings (both 64 characters)."""
    idx = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    first_diff = F.array_position(
        F.transform(idx, lambda i: F.substring(a, i, 1) != F.substring(b, i, 1)), True)
    return F.when(first_diff == 0, F.least(F.length(a), F.length(b))).otherwise(first_diff - 1)


def min_hashlet_len(hashes: DataFrame, col: str = "hash") -> DataFrame:
    """One row ``min_len``: shortest prefix length (4..64) unique over ``col``."""
    counted = hashes.groupBy(col).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.substring(col, 1, MIN_LEN)).orderBy(col)
    adj = counted.withColumn("_prev", F.lag(col).over(w)).select(
        F.when(F.col("_n") > 1, F.lit(MAX_LEN))
        .when(F.col("_prev").isNotNull(), _lcp(F.col(col), F.col("_prev")) + 1)
        .otherwise(F.lit(MIN_LEN)).alias("_need"))
    return adj.agg(
        F.least(F.lit(MAX_LEN), F.greatest(F.lit(MIN_LEN), F.coalesce(F.max("_need"), F.lit(MIN_LEN))))
        .cast("int").alias("min_len"))


def _asked_buckets(cand: DataFrame) -> DataFrame:
    """The 4-character buckets that the prefixes reach, at most 65,536: their own, and all
    completions of shorter ones."""
    missing = F.greatest(F.lit(MIN_LEN) - F.col("_len"), F.lit(0))
    ends = F.transform(F.sequence(F.lit(0), (F.pow(F.lit(16), missing) - 1).cast("int")),
                       lambda i: F.when(missing > 0, F.lpad(F.lower(F.hex(i)), missing, "0")).otherwise(F.lit("")))
    return cand.select(F.explode(F.transform(ends, lambda e: F.concat(F.substring("_p", 1, MIN_LEN), e))).alias("_b")).distinct()


def resolve_prefixes(history: DataFrame, prefixes: DataFrame, col: str = "prefix") -> DataFrame:
    """Classify each prefix against the history's hashes.

    Output: prefix, status (empty / invalid / not_found / ambiguous / found),
    hash, cmd, cwd, ts_ms, source (NULL unless found).

    A prefix stands for an interval of hashes, and in the order of (hash or
    prefix) it comes right before them. The history is read once: its rows in
    buckets that some prefix reaches are dealt, together with the prefixes, by
    their first four characters and sorted; the next hash after a prefix and the
    one after that decide. Prefixes shorter than a bucket are decided by the first
    two hashes of each of their buckets (at most 131,072 rows).
    """
    p = prefixes.select(F.col(col).alias("prefix")).withColumn("_p", F.lower(F.coalesce("prefix", F.lit(""))))
    p = p.withColumn("_len", F.length("_p")).withColumn(
        "_valid", (F.col("_len") > 0) & F.col("_p").rlike("^[0-9a-f]+$"))
    cand = materialize(p.filter(F.col("_valid") & (F.col("_len") <= MAX_LEN)).select("_p", "_len").distinct(), "prefixes")

    detail = F.struct("hash", "cmd", "cwd", "ts_ms", "source")
    bucket = F.substring("hash", 1, MIN_LEN).alias("_b")
    rows = history.select("hash", "cmd", "cwd", "ts_ms", "source", bucket).join(
        F.broadcast(_asked_buckets(cand)), "_b", "left_semi")  # at most 65,536 buckets
    stream = rows.select("_b", F.col("hash").alias("_key"), detail.alias("_d")).unionByName(
        cand.filter(F.col("_len") >= MIN_LEN).select(F.substring("_p", 1, MIN_LEN).alias("_b"), F.col("_p").alias("_key")),
        allowMissingColumns=True)
    # buckets are even (SHA-256): as many tasks as the rows ask for
    tasks = max(int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((history.count() + cand.count()) / ROWS_PER_TASK))
    stream = stream.repartition(tasks, "_b")
    # backwards, so that what follows a prefix has been seen; a hash comes before a prefix equal to it
    seen = Window.partitionBy("_b").orderBy(F.col("_key").desc(), F.col("_d").isNull().asc())
    upto = seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = (stream.withColumn("_after", F.last(F.col("_d.hash"), ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("_next", F.last(F.when(F.col("_d").isNotNull(), F.struct("_d", "_after")), ignorenulls=True).over(upto))
              .withColumn("_nth", F.count(F.col("_d.hash")).over(upto)))
    decided = materialize(stream.filter(F.col("_d").isNull() | (F.col("_nth") <= 2)), "prefix-stream")

    near, key = F.col("_next._d.hash"), F.col("_key")
    long = decided.filter(F.col("_d").isNull() & near.startswith(key)).select(
        key.alias("_p"), F.when(F.col("_next._after").startswith(key), 2).otherwise(1).alias("_n"), F.col("_next._d").alias("_d"))
    levels = F.explode(F.array(*[F.substring("_key", 1, k) for k in range(1, MIN_LEN)])).alias("_p")
    short = decided.filter(F.col("_d").isNotNull()).select("_d", levels).groupBy("_p").agg(
        F.count(F.lit(1)).cast("int").alias("_n"), F.first("_d").alias("_d"))
    matched = long.unionByName(short)

    res = p.repartition(tasks, "_p").join(matched.repartition(tasks, "_p"), "_p", "left")
    status = (F.when(F.col("_len") == 0, "empty")
              .when(~F.col("_valid"), "invalid")
              .when(F.coalesce(F.col("_n"), F.lit(0)) == 0, "not_found")
              .when(F.col("_n") > 1, "ambiguous")
              .otherwise("found"))
    res = res.withColumn("status", status)
    return res.select("prefix", "status", *[
        F.when(F.col("status") == "found", F.col(f"_d.{c}")).alias(c) for c in ("hash", "cmd", "cwd", "ts_ms", "source")])
