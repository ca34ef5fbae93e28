"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most ``2 s - 1`` bits agree, in one of ``s``
segments, up to one bit. Each fingerprint is therefore indexed, for each of
``s = (distance + 1) / 2`` segments, under the segment's variants with one bit
deleted; equal variants are joined and every candidate is verified by the whole
Hamming distance. Only distinct fingerprints are indexed, and a group of equal
variants yields the edges of a spanning forest of its links, never its pairs.
One fingerprint has ``64`` variants, so no key can hold more than 1/64 of the
index rows. A variant that more than ``GROUP`` distinct fingerprints share is
found before anything is dealt; its members are dealt by the variants of their
other bits as well, so no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, discard, keep_rows, key_runs, stored, text_key

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
GROUP = 65_536       # distinct fingerprints under one variant, beyond which they are dealt by further bits
PER_TASK = 262_144   # distinct fingerprints of one indexing task
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a text's word shingles; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    m = max(1, len(words) - shingle + 1)
    ends = stops[shingle - 1:] if len(words) >= shingle else stops[-1:]
    view, digest = memoryview(body), xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(view[a:b], seed) for a, b in zip(starts[:m].tolist(), ends.tolist())], np.uint64, m)
    counts = np.zeros(64, np.int64)
    for at in range(0, m, 4096):
        block = hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: _key, doc_id, fp (the 64 bits as a signed bigint)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["_key", "doc_id", "fp"])

    rows = docs.select(text_key(F.col("doc_id"), F.col("text")).alias("_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "_key string, doc_id long, fp long")


def _cuts(width: int, max_bits: int) -> list[int]:
    """Segment borders: of the differing bits, at most one falls into one of the segments."""
    n = (max_bits + 2) // 2
    return [width * i // n for i in range(n + 1)]


def _segment(x: Column, lo: int, width: int) -> Column:
    seg = F.shiftrightunsigned(x, lo)
    return seg.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else seg


def _without(seg: Column, j: int) -> Column:
    """A segment with its bit ``j`` deleted."""
    below = seg.bitwiseAND(F.lit((1 << j) - 1))
    return F.shiftleft(F.shiftrightunsigned(seg, j + 1), j).bitwiseOR(below) if j < 63 else below


def _keys(x: Column, width: int, max_bits: int) -> list[list[Column]]:
    """Per segment of ``x`` and deleted bit: the variant and the bit's position, in one number."""
    cuts = _cuts(width, max_bits)
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        seg = _segment(x, lo, hi - lo)
        out.append([F.xxhash64(_without(seg, j), F.lit(lo + j)) if hi - lo > 50 else
                    F.shiftleft(_without(seg, j), 6).bitwiseOR(F.lit(lo + j)) for j in range(hi - lo)])
    return out


def crowded(fps: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Variants that may hold more than ``group`` of the distinct ``fps``: rows (seg, value, mask), the
    bits of ``mask`` being those whose deletion from a segment of this value gives such a variant.

    A variant holds two values of its segment, so counting values is enough: two rows per
    fingerprint, combined in each task, instead of one per variant.
    """
    cuts = _cuts(64, max_bits)
    widths = [hi - lo for lo, hi in zip(cuts, cuts[1:])]
    values = F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("fp"), cuts[s], w).alias("value")) for s, w in enumerate(widths)])
    often = (fps.select(F.explode(values).alias("x")).groupBy("x.seg", "x.value").count().filter(F.col("count") > group // 2))
    # a frequent value crowds all its variants, which the values one bit away share
    near = [F.array(F.struct(F.col("value"), F.lit((1 << w) - 1).cast("bigint").alias("mask")),
                    *[F.struct(F.col("value").bitwiseXOR(F.lit(1 << j)).alias("value"), F.lit(1 << j).cast("bigint").alias("mask"))
                      for j in range(w)]) for w in widths]
    pick = near[0]
    for s in range(1, len(widths)):
        pick = F.when(F.col("seg") == s, near[s]).otherwise(pick)
    return (often.select("seg", F.explode(pick).alias("x")).groupBy("seg", "x.value").agg(F.bit_or("x.mask").alias("mask")))


def variants(fps: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Index rows (v, fp) of the distinct ``fps``: each segment with each of its bits deleted in turn.

    Fingerprints of a crowded variant are indexed under the variants of their remaining bits
    beside it: of these bits, too, one segment differs in at most one.
    """
    cuts = _cuts(64, max_bits)
    n_seg = len(cuts) - 1
    keys = _keys(F.col("fp"), 64, max_bits)
    if n_seg == 1:  # a variant of the whole fingerprint holds two at most
        return fps.select(F.explode(F.array(*keys[0])).alias("v"), "fp")
    crowd = stored(crowded(fps, max_bits, group), "crowded-variants")
    marked = fps
    for s in range(n_seg):
        marked = marked.join(crowd.filter(F.col("seg") == s).select(F.col("value").alias(f"v{s}"), F.col("mask").alias(f"m{s}")),
                             _segment(F.col("fp"), cuts[s], cuts[s + 1] - cuts[s]) == F.col(f"v{s}"), "left")
    masks = [F.coalesce(F.col(f"m{s}"), F.lit(0).cast("bigint")) for s in range(n_seg)]

    def exploded(rows: DataFrame, wanted: bool) -> DataFrame:
        each = [F.when((masks[s].bitwiseAND(F.lit(1 << j)) != 0) == wanted, k) for s in range(n_seg) for j, k in enumerate(keys[s])]
        return rows.select(F.explode(F.array(*each)).alias("v"), "fp").filter(F.col("v").isNotNull())

    plain = exploded(marked, False)
    busy = exploded(marked.filter(F.coalesce(*[F.col(f"m{s}") for s in range(n_seg)]).isNotNull()), True)
    finer = None
    for s in reversed(range(n_seg)):
        lo, hi = cuts[s], cuts[s + 1]
        rest = F.col("fp").bitwiseAND(F.lit((1 << lo) - 1))
        rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", hi), lo)) if hi < 64 else rest
        keys_s = F.array(*[F.xxhash64("v", k) for part in _keys(rest, 64 - (hi - lo), max_bits) for k in part])
        finer = keys_s if finer is None else F.when(F.col("v").bitwiseAND(F.lit(63)) < hi, keys_s).otherwise(finer)
    return plain.unionByName(busy.select(F.explode(finer).alias("v"), "fp"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among distinct fingerprints sharing a variant.

    A member is compared with all members of other components, in one vector
    operation, unless its component already holds everything; memory is linear.
    """
    n = len(fp)
    comp = np.arange(n)
    edges = []
    # start near the middle of the group: its ball usually takes most of it
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    middle = np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]
    order = np.argsort(_popcount(fp ^ middle), kind="stable")
    biggest = -1
    for at, i in enumerate(order.tolist()):
        if comp[i] == biggest:
            continue  # pairs with members outside are found from the outside
        others = np.flatnonzero(comp != comp[i])
        if not len(others):
            break
        near = others[_popcount(fp[others] ^ fp[i]) <= max_bits]
        if len(near):
            labels, first = np.unique(comp[near], return_index=True)
            edges.extend((int(i), int(near[k])) for k in first)
            comp[np.isin(comp, labels)] = comp[i]
        if at == 0:
            biggest = comp[i]
    return edges


def links(fps: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Verified edges (a, b), a < b, whose components are those of all links of ``fps``.

    No task holds more than ``group`` fingerprints of one variant, nor, of a crowded one, more than
    those equal in both deletion variants: with 3 bits, 2^18 fingerprints of 8 bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges_of(v: np.ndarray, fp: np.ndarray):
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            starts = np.concatenate([[0], cut])
            sizes = np.diff(np.append(starts, len(v)))
            two = starts[sizes == 2]
            ok = two[_popcount(fp[two] ^ fp[two + 1]) <= max_bits]
            a, b = [fp[ok]], [fp[ok + 1]]
            for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                e = _forest(fp[s:s + m], max_bits)
                if e:
                    x, y = np.array(e).T
                    a.append(fp[s + x])
                    b.append(fp[s + y])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for v, fp in key_runs(batches):
            yield edges_of(v, fp.view(np.uint64))

    distinct = stored(fps.select("fp").distinct(), "distinct-fingerprints")
    # 64 variants each: tasks are sized by the fingerprints' number, not by their few bytes
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, bucket_count(distinct.count(), PER_TASK))
    index = variants(distinct.repartition(tasks, "fp"), max_bits, group)
    dealt = index.repartition("v").sortWithinPartitions("v")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (fp, label), label the smallest member.

    Every member takes the smallest label around it, then labels are replaced by
    their labels' labels, until nothing changes. Each round is one written table;
    partial minima are taken before each exchange, joins may split hot members.
    """
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
                  .union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))), "links")
    state = stored(both.groupBy("x").agg(F.min("y").alias("m"))
                   .select(F.col("x").alias("fp"), F.least("x", "m").alias("label")), "labels")
    while True:
        seen = (both.join(state, both.y == state.fp).groupBy("x").agg(F.min("label").alias("near")))
        hooked = state.join(seen, state.fp == seen.x).select("fp", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = state.select(F.col("fp").alias("label"), F.col("label").alias("up"))
        nxt = stored(hooked.join(up, "label", "left").select("fp", F.least("label", F.coalesce("up", "label")).alias("label"),
                                                           "old"), "labels")
        changed = nxt.filter(F.col("label") != F.col("old")).limit(1).count()
        discard(state)
        state = nxt
        if not changed:
            discard(both)
            return state.select("fp", "label")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, _key, _label.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, the row's own included (null only if no member
    has a doc_id). Null texts and texts without words have fingerprint zero and
    link like any other; fewer words than a shingle give one shingle of all words.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    label = components(links(rows, max_bits))
    # smallest doc_id by fingerprint first: only one row per fingerprint meets the components
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = least.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    by_label = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = grouped.select("fp", "label").join(by_label, "label").select("fp", "component_id", F.col("label").alias("_label"))
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_key", "_label")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs``, all columns, with one row of each component: its smallest doc_id's.

    A component without any doc_id keeps the row with the smallest text key.
    """
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_key").alias("k"))
    keepers = near_duplicates(docs, max_bits, shingle).groupBy("_label").agg(F.min(first).alias("first"))
    return keep_rows(docs, keepers.select(F.col("first.k").alias("_key")))
