"""K-d tree sharding on document metadata.

Leaves are cut out of the table recursively: a node that must yield more than
one leaf is split along the metadata dimension in which it is widest, at the
weighted median (weights are bytes; a node of ``m`` leaves gives ``m // 2`` of
them, and that share of its bytes, to the left). All nodes of a level are split
by the same few jobs: one aggregation for the widths, then histograms of a
63-bit split key, each refining the bins that hold the medians, until the
medians are exact or the bin left is a negligible part of a leaf. Histograms
have at most ``nodes x BINS`` rows, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, discard, stored

BINS_BITS = 10
KEY_BITS = 60
SCALE_BITS = 20               # of the key: position in the node's range; the rest breaks ties
TOLERANCE = 0.0005            # of a leaf's bytes: a bin this light is not refined
PER_SLOT_TASK = 100_000


def default_dimensions() -> dict[str, Column]:
    """Numeric metadata of ``documents``: size (log scale), language, source, id."""
    def code(c):
        return F.when(F.col(c).isNull(), -1).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 16))).cast("double")
    return {"size": F.log1p(F.col("size")), "lang": code("lang"), "source": code("source"),
            "id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))}


def _bits(value: Column, at: int) -> Column:
    return F.shiftrightunsigned(value, at)


def kd_leaves(rows: DataFrame, n_leaves: int, dims: Sequence[str], weight: str = "size",
              tie: str = "_tie") -> DataFrame:
    """``rows`` plus ``shard`` (0 .. n_leaves - 1), by recursive weighted-median splits.

    ``tie``: a well-spread bigint that orders rows equal in the split dimension.
    Every row gets a leaf; an empty table gives an empty result.
    """
    # each dimension is measured in units of its range over the whole table
    span = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    widths = {d: (span[f"hi_{d}"] or 0.0) - (span[f"lo_{d}"] or 0.0) for d in dims}
    nodes = {0: n_leaves}     # first leaf of a node -> its number of leaves
    at = rows.withColumn("_node", F.lit(0))
    level = None
    while any(m > 1 for m in nodes.values()):
        open_ = [k for k, m in nodes.items() if m > 1]
        stat = at.filter(F.col("_node").isin(open_)).groupBy("_node").agg(
            F.sum(weight).alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims],
            *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()
        plan = {}
        for r in stat:
            # the first named of equally wide dimensions is split
            share = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / widths[d] if widths[d] else 0.0 for d in dims}
            d = max(dims, key=lambda x: share[x])
            m = nodes[r["_node"]]
            plan[r["_node"]] = (d, r[f"lo_{d}"], r[f"hi_{d}"] - r[f"lo_{d}"], r["w"] * (m // 2) / m,
                                r["w"] / m * TOLERANCE)
        bounds = _medians(at, plan, weight, tie)
        child = F.when(F.lit(False), F.lit(0))
        new = {k: m for k, m in nodes.items() if m == 1}
        for k in open_:
            left = nodes[k] // 2
            new[k], new[k + left] = left, nodes[k] - left
            if k in plan:
                right = _key(*plan[k][:3], tie) >= F.lit(bounds[k])
                child = child.when(F.col("_node") == k, F.when(right, k + left).otherwise(k))
        # the level is written: the next reads a column, not a growing expression
        written = stored(at.withColumn("_node", child.otherwise(F.col("_node")).cast("int")), "kd-level")
        if level is not None:
            discard(level)
        at = level = written
        nodes = new
    return at.withColumnRenamed("_node", "shard")


def _key(d: str, lo: float, width: float, tie: str) -> Column:
    """Split key in [0, 2^60): position in the node's range, then the tie breaker."""
    top = (1 << SCALE_BITS) - 1
    pos = F.floor((F.col(d) - F.lit(lo)) / F.lit(width) * F.lit(float(top))) if width else F.lit(0)
    pos = F.greatest(F.lit(0), F.least(F.lit(top), pos)).cast("bigint")
    low = KEY_BITS - SCALE_BITS
    return F.shiftleft(pos, low).bitwiseOR(F.col(tie).bitwiseAND(F.lit((1 << low) - 1)))


def _medians(at: DataFrame, plan: dict, weight: str, tie: str) -> dict[int, int]:
    """Smallest key bound of each node whose lower side holds its target weight."""
    key = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for k, (d, lo, width, _, _) in plan.items():
        key = key.when(F.col("_node") == k, _key(d, lo, width, tie))
    keyed = at.filter(F.col("_node").isin(list(plan))).select("_node", key.alias("_k"), F.col(weight).alias("_w"))
    prefix = {k: 0 for k in plan}   # key prefix that holds the median
    below = {k: 0 for k in plan}    # weight below it
    done: dict[int, int] = {}
    shift = KEY_BITS
    while shift > 0 and len(done) < len(plan):
        shift -= BINS_BITS
        here = F.lit(False)
        for k in plan:
            if k not in done:
                here = here | ((F.col("_node") == k) & (_bits(F.col("_k"), shift + BINS_BITS) == F.lit(prefix[k])))
        hist = keyed.filter(here).groupBy("_node", _bits(F.col("_k"), shift).alias("b")).agg(F.sum("_w").alias("w")).collect()
        by_node: dict[int, list] = {}
        for r in hist:
            by_node.setdefault(r["_node"], []).append((r["b"], r["w"]))
        for k, bins in by_node.items():
            target, tolerance = plan[k][3], plan[k][4]
            for b, w in sorted(bins):
                if below[k] + w >= target or b == max(bins)[0]:
                    prefix[k] = b
                    # a light bin, or the last refinement: the nearer edge is the median
                    if w <= tolerance or shift == 0:
                        upper = below[k] + w - target <= target - below[k]
                        done[k] = (b + 1 if upper else b) << shift
                    break
                below[k] += w
    return done


def shard(docs: DataFrame, n_shards: int = 24, dims: dict[str, Column] | None = None,
          per_task: int = PER_SLOT_TASK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 8; shards hold nearly equal bytes.
    ``slot`` counts a shard's rows without gaps from 0. A null text counts as
    empty (size 8, checksum 0); null metadata sorts first. Repeated rows get
    slots of their own: ties are broken by a hash of the document, then by a number
    drawn for each row once the metadata is written, so no group of equal rows
    must stay in one shard.
    """
    dims = dims or default_dimensions()
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select("doc_id", *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")],
                       (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    meta = meta.select("doc_id", "size", "text_crc32", *[c.alias(f"_d_{d}") for d, c in dims.items()],
                       F.monotonically_increasing_id().alias("_row"))
    # 52 bits of the document, the same in every run, and 12 of the row, to part equal rows
    tie = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit(-4096)).bitwiseOR(F.xxhash64("_row").bitwiseAND(F.lit(4095)))
    meta = stored(meta, "kd-metadata").withColumn("_tie", tie)
    placed = kd_leaves(meta, n_shards, [f"_d_{d}" for d in dims])
    # gapless slots without one task per shard: rank inside small buckets plus the buckets' offsets
    n_buckets = bucket_count(placed.count(), per_task)
    placed = placed.withColumn("_bucket", F.pmod(F.col("_tie"), F.lit(n_buckets)))
    sizes = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_tie", "_row")
    return (placed.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(offsets, ["shard", "_bucket"])
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    (F.col("_offset") + F.col("_rank")).cast("bigint").alias("slot")))
